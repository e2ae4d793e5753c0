"""Personal data, licenses, languages and media columns against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import jpeg_store, langid, license_scan, pii, queries

SF = "/root/testdata/sf0.01"
driver_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    cards = [(m, re.sub("[^0-9]", "", m[0])) for m in CARD.finditer(text)]
    found += [(m.start(), 2, m.end()) for m, d in cards if 14 <= len(d) <= 19 and checksum(d)]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_against_plain_patterns(rng):
    parts = ["a", "b.", "@", "@x.", "-", ".", "1", "22", "255", "300", "0001", "4111 1111 1111 1111", "+1", "(", ")", " ", "_", "%", "é", "4539-1488-0343-6467", ".com", "+", "9", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    dots = "1.2." * 50_000
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + dots
    assert pii.base_spans(text) == [(a + 600_002, k, b + 600_002) for a, k, b in pii.base_spans(dots)]


@driver_tables
def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op1_pii"](spark, SF).collect():
        spans = plain_spans(texts[r["doc_id"]])
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == n for _, x, _ in spans) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and s.split(":")[0] in pii.KINDS] == [s for s in listed.split(",") if s]


def values_of(text):
    """The protected values of a text, however they are spelled, and its terms outside of their matches with their places."""
    spans = plain_spans(text)
    values = {(k, text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b])) for a, k, b in spans}
    terms = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
    return values, terms


def disclosures(texts):
    """Disclosure of each (value, term) by the definition, counting documents directly."""
    held = [values_of(t) for t in texts]
    n_value, n_term, n_both = Counter(), Counter(), Counter()
    for (values, terms), text in zip(held, texts):
        n_value.update(values)
        n_term.update({w.lower() for w in re.findall(r"[^\W_]+", text)})
        n_both.update({(v, w) for v in values for w, _, _ in terms})
    out = {}
    for (v, w), both in n_both.items():
        content = math.log(len(texts) / n_value[v])
        if n_term[w] >= pii.SUPPORT and content > 0:
            out[v, w] = math.log(len(texts) * both / (n_value[v] * n_term[w])) / content
    return {k: d for k, d in out.items() if d >= pii.GENERALISE}


def plain_sanitise(texts):
    """Texts with matches and disclosing terms masked, by direct counts; a generalised term's mark isn't told apart."""
    marks, found, out = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]"), disclosures(texts), []
    for text in texts:
        values, terms = values_of(text)
        spans = [(a, b, marks[k]) for a, k, b in plain_spans(text)]
        for w, a, b in terms:
            most = max((found.get((v, w), 0) for v in values), default=0)
            if most >= pii.GENERALISE:
                spans.append((a, b, "" if most >= pii.REMOVE else "[?]"))
        made, at = [], 0
        for a, b, mark in sorted(spans):
            if a >= at:
                made += [text[at:a], mark]
            at = max(at, b)
        out.append("".join(made) + text[at:])
    return out


def kinds_hidden(text):
    return re.sub(r"\[(NUMBER|CODE|WORD|NAME|PERSON|PLACE|ORGANISATION)\]", "[?]", text)


def test_disclosing_terms_against_direct_counts(spark, table, rng):
    common = ["people", "often", "write", "letters", "about", "things"]
    texts = [" ".join(rng.choice(common) for _ in range(12)) for _ in range(60)]
    for k in range(3):
        texts[k] += f" chairman Zyxwv reach me at boss@corp.example.com please Zyxwv {rng.choice(common)}"
    texts[3] += " other@corp.example.com unique"
    texts[4] += " Zyxwv elsewhere"
    # A value that most of its documents hold without the word: the word tells little of it.
    for k in range(10, 20):
        texts[k] += " 10.1.2.3" + (" rareword" if k < 12 else "")
    texts[30] += " rareword"
    texts[31] += " rareword"
    docs = table(texts)
    want = {(f"{pii.KINDS[k]}:{v}", w): d for ((k, v), w), d in disclosures(texts).items()}
    found = pii.scanned(docs, "doc_id", "text", docs["doc_id"])
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosing(docs, found, "text").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert ("email:boss@corp.example.com", "chairman") in want and not any(c in common or c == "rareword" for _, c in want)
    kept = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert [kinds_hidden(kept[k]) for k in range(60)] == plain_sanitise(texts)
    assert "boss@" not in kept[0] and "chairman" not in kept[0] and "[EMAIL]" in kept[3] and "unique" in kept[3] and "rareword" in kept[11]


@driver_tables
def test_sanitised_documents_against_direct_counts(spark):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: kinds_hidden(r["text"]) for r in pii.sanitise(docs).collect()}
    assert got == dict(zip(texts, plain_sanitise(list(texts.values()))))


def test_a_log_of_many_addresses_takes_linear_time(spark, table):
    """Forty thousand addresses and as many rare words in each of two texts make no pair of each with each."""
    log = " ".join(f"10.{k >> 8 & 255}.{k & 255}.{k >> 16} host{k}" for k in range(40_000))
    rows = {r["doc_id"]: r for r in pii.find(table([log, log + " end", *["plain text"] * 50])).collect()}
    assert rows[0]["n_ip"] == rows[1]["n_ip"] == 40_000 and rows[0]["n_terms"] == 40_000 and rows[5]["n_found"] == 0


def test_terms_are_generalised_to_their_kind():
    cases = {"in 1984 x": "[NUMBER]", "the x9y case": "[CODE]", "Dr. Mabuse came": "[PERSON]", "at Acme Inc. today": "[ORGANISATION]", "on Baker Street 2": "[PLACE]", "from Lisbon to": "[PLACE]",
             "when Alice met": "[NAME]", "a gadget for": "[WORD]"}
    places = {"in 1984 x": "1984", "the x9y case": "x9y", "Dr. Mabuse came": "Mabuse", "at Acme Inc. today": "Acme", "on Baker Street 2": "Baker", "from Lisbon to": "Lisbon", "when Alice met": "Alice",
              "a gadget for": "gadget"}
    for text, kind in cases.items():
        start = text.index(places[text])
        assert pii.masked(text, [(start, pii.GENERALISED, start + len(places[text]))]) == text.replace(places[text], kind)


def test_disclosing_terms_are_masked_in_the_whole_text(spark, table):
    """A short name and one with digits, far from the value, wherever they stand in the texts that hold it."""
    common = "people often write letters about things"
    value = f"Li x9 {common} {common} {common} {common} {common} first@corp.example.com {common} {common} {common} {common} Li signed"
    texts = [value, value + " twice", f"Li {common}", *[f"{common} number {k % 3}" for k in range(300)]]
    kept = {r["doc_id"]: r["text"] for r in pii.sanitise(table(texts)).collect()}
    for k in (0, 1):
        assert "Li" not in kept[k] and "x9" not in kept[k] and kept[k].count(common) == 9 and "first@" not in kept[k]
    assert all(kept[k] == texts[k] for k in range(2, 303))


def test_terms_disclose_values_of_one_document(spark, table):
    """Values seen once, short names and names with digits: a rare term of a text that holds a value is masked in all of it."""
    common = "people often write letters about things"
    texts = [f"{common} number {k % 3}" for k in range(300)]
    texts[0] = f"Li x9 {common} {common} {common} {common} {common} first@corp.example.com {common} {common} {common} {common} Li signed"
    texts[1] = f"Li {common}"
    texts[2] = f"x9 {common}"
    kept = {r["doc_id"]: r["text"] for r in pii.sanitise(table(texts)).collect()}
    assert "Li" not in kept[0] and "x9" not in kept[0] and kept[0].count(common) == 9 and "first@" not in kept[0]
    assert "signed" in kept[0] and all(kept[k] == texts[k] for k in range(1, 300))
    rows = {r["doc_id"]: r["n_terms"] for r in pii.find(table(texts)).collect()}
    assert rows[0] == 3 and not any(rows[k] for k in range(1, 300))


def test_masking_overlaps():
    assert pii.masked("call +1 234 567 8901 now", [(5, 3, 20), (6, 2, 20)]) == "call [PHONE] now"
    assert pii.masked(None, []) is None


@pytest.mark.parametrize("name", license_scan.NOTICES)
def test_whole_notices_are_covered(name):
    rng, scanner = random.Random(3), license_scan.Scanner(license_scan.NOTICES, license_scan.COVERAGE)
    filler = " ".join(rng.choice(["the", "of", "software", "any", "word", "license"]) for _ in range(3000))
    notice = license_scan.NOTICES[name].text
    for text in (notice, f"{filler}\n{notice}\n{filler}", notice.upper().replace(" ", "\n  ")):
        hits = {h[0]: h for h in scanner.scan(text)}
        assert hits[name][1] == 1.0
        cut = text[hits[name][3]: hits[name][4]].lower()
        assert license_scan.words_of(cut) == license_scan.words_of(notice)


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_alignment_is_common_and_rising(rng):
    for _ in range(2000):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= common_length(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(pairs) == common_length(a, b)


def test_increasing(rng):
    for _ in range(500):
        values = [rng.randrange(12) for _ in range(rng.randrange(10))]
        got = [values[k] for k in license_scan.increasing(values)]
        chosen = ([v for k, v in enumerate(values) if m >> k & 1] for m in range(1 << len(values)))
        best = max(len(c) for c in chosen if all(x < y for x, y in zip(c, c[1:])))
        assert got == sorted(set(got)) and len(got) == best


SHORT = {"one": "alpha beta gamma delta epsilon zeta eta theta iota kappa", "two": license_scan.Notice("red green blue white black", "green", "pink")}


def covered(words, notice):
    """Whether any stretch of the words holds enough of the notice, by the longest common subsequence of every stretch."""
    want, keys, unless = license_scan.words_of(notice.text), set(notice.keys.split()), set(notice.unless.split())
    return any(common_length(words[a:b], want) >= license_scan.COVERAGE * len(want) and keys <= set(words[a:b]) and not unless & set(words[a:b])
               for a in range(len(words)) for b in range(a + 1, len(words) + 1))


def test_scan_against_every_stretch(rng):
    """Words left out, other words between (three at each place), several notices: as by common subsequences."""
    scanner = license_scan.Scanner(SHORT, license_scan.COVERAGE)
    seen = Counter()
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(4)):
            words += rng.choices(["x", "y", "pink"], k=rng.randrange(6))
            notice = SHORT[rng.choice(["one", "two"])]
            for w in license_scan.words_of(getattr(notice, "text", notice)):
                if rng.random() < 0.92:
                    words += [w, *rng.choices(["x", "y", "z"], k=rng.choice([0, 0, 1, 3]))]
        hits = Counter(h[0] for h in scanner.scan(" ".join(words)))
        for name, notice in SHORT.items():
            notice = notice if isinstance(notice, license_scan.Notice) else license_scan.Notice(notice)
            # A notice may also lie across two broken ones, which alignment on unique words needn't see.
            if hits[name]:
                assert covered(words, notice), words
            elif sum(w == license_scan.words_of(notice.text)[0] for w in words) < 2:
                assert not covered(words, notice), words
            seen[name, hits[name]] += 1
    assert seen["one", 2] and seen["two", 2] and seen["one", 0]


def test_every_occurrence_is_found():
    scanner, line = license_scan.Scanner(license_scan.NOTICES, license_scan.COVERAGE), license_scan.NOTICES["mit-line"].text
    text = f"{line} Some words in between, of no license. {line}"
    assert [h[3] for h in scanner.scan(text) if h[0] == "mit-line"] == [0, text.rindex(line)]
    spread = " a b c ".join(license_scan.words_of(license_scan.NOTICES["gpl-3.0-line"].text))
    assert [h[0] for h in scanner.scan(spread)] == ["gpl-3.0-line"]


@pytest.mark.parametrize("text, names", [
    ("Released under the BSD License.", {"bsd-line"}), ("Licensed under CC BY 4.0.", {"cc-by-4.0-line"}), ("Licensed under CC BY-SA 4.0.", {"cc-by-sa-4.0-line"}),
    ("This work is licensed under the GNU General Public License, version 2.", {"gpl-2.0-line"}), ("This work is licensed under the GNU Lesser General Public License, version 3.", {"lgpl-3.0-line"}),
    ("This work is licensed under the GNU Affero General Public License, version 3.", {"agpl-3.0-line"}), ("Licensed under the Apache License, Version 1.1.", set()), ("the license of it", set())])
def test_licenses_are_told_apart(text, names):
    assert {h[0] for h in license_scan.Scanner(license_scan.NOTICES, license_scan.COVERAGE).scan(text)} == names


@driver_tables
def test_license_query(spark):
    """Against every occurrence of a line's words, with up to two other words at each place, found by patterns in whole texts."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [(r["doc_id"], r["license"], r["start"], r["end"]) for r in queries.QUERIES["op3_license_scan"](spark, SF).collect()]
    found = 0
    for name in ("apache-2.0-line", "mit-line", "bsd-line", "gpl-3.0-line", "cc-by-nc-4.0-line"):
        pattern = re.compile(r"\b" + r"\W+(?:\w+\W+){0,2}?".join(license_scan.words_of(license_scan.NOTICES[name].text)) + r"\b", re.IGNORECASE)
        want = {(k, name, m.start(), m.end()) for k, t in texts.items() for m in pattern.finditer(t)}
        got = {r for r in rows if r[1] == name}
        assert want <= got
        # What is found besides lacks a word or has more words between.
        assert all(license_scan.align(license_scan.words_of(texts[k][a:b]), license_scan.words_of(license_scan.NOTICES[name].text)) for k, _, a, b in got - want)
        found += len(want)
    assert found and len(rows) == len(set(rows))


def phrases(text, sample):
    at = count = 0
    while at < len(text):
        end = at
        while end < len(text) and text[at: end + 1] in sample:
            end += 1
        at, count = max(end, at + 1), count + 1
    return count


@pytest.mark.parametrize("block, batch", [(512, 1 << 20), (7, 100), (3, 13), (1, 1)])
def test_phrases_against_substring_search(rng, monkeypatch, block, batch):
    """Texts of one block and of very many, parsed at once or in parts: the greedy parse of the whole text."""
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "BATCH_BYTES", batch)
    samples = tuple(re.sub(b" +", b" ", "".join(rng.choice(letters) for _ in range(300)).encode()) for letters in ("ab c", "bcd e", "é xa", "a"))
    parser = langid.Parser(langid.Model(("x", "y", "z", "w"), samples))
    texts = [re.sub(b" +", b" ", "".join(rng.choice("abcdeé zq") for _ in range(rng.randrange(1, 200))).strip().encode()) or b"a" for _ in range(60)]
    texts += [re.sub(b" +", b" ", samples[0] * 3).strip(), b"a" * 1500, re.sub(b" +", b" ", "".join(rng.choice("abc ") for _ in range(5000)).strip().encode())]
    counts, sizes, _ = parser.phrases(texts)
    want = [[phrases(t, s) for s in samples] for t in texts]
    assert sizes.tolist() == list(map(len, texts)) and counts.tolist() == want
    assert [parser.long_phrases(t)[0][0].tolist() for t in texts[-6:]] == want[-6:]


@driver_tables
def test_language_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_language_id"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for k, r in got.items())
    out = [k for k, r in got.items() if r["held_out"]]
    assert sum(got[k]["lang_pred"] == docs[k]["lang"] for k in out) >= 0.97 * len(out)


def test_held_out_rows_and_missing_letters(spark):
    rows = [(k, "aaa bbb" if k % 2 else "ccc ddd", "x" if k % 2 else "y") for k in range(40)] + [(50, "12 !", "x"), (51, None, "x"), (52, "aa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got[50] == got[51] == "und" and got[52] == "x" and all(got[k] == ("x" if k % 2 else "y") for k in range(40))
    # Labels of rows that are held out change nothing.
    other = spark.createDataFrame([(k, t, "z" if zlib.crc32(str(k).encode()) % 4 == 2 else x) for k, t, x in rows], docs.schema)
    assert langid.fit(other) == model


def test_every_labelled_language_is_learned(spark, rng):
    """Seventy languages of many scripts, one of them with few texts that have letters among many rows, one with only long texts."""
    scripts = [0x61, 0x3b1, 0x430, 0x5d0, 0x628, 0x905, 0xe01, 0x10d0, 0x1200, 0x4e00, 0xac00]
    words = {f"l{n:02}": ["".join(chr(scripts[n % len(scripts)] + rng.randrange(20)) for _ in range(6)) for _ in range(8)] for n in range(70)}
    rows = [(lang, " ".join(rng.choice(own) for _ in range(12))) for lang, own in words.items() for _ in range(5 if lang > "l05" else 9)]
    rows += [("few", "12 34")] * 2_000 + [("few", "ééé üüü ößß")] * 4 + [("long", "øåæ æåø " * n) for n in (900, 901, 902, 903, 904)]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model.names) == {*words, "few", "long"} and max(map(len, model.samples)) < 20_000
    parser = langid.Parser(model)
    texts = [" ".join(own) for own in words.values()] + ["ééé üüü", "øåæ æåø"]
    assert parser.predict(texts, len(texts))[0] == [*words, "few", "long"]
    # What a worker holds is mapped from a file.
    assert parser.table.base is not None and parser.table.size < 1 << 27


def test_ties_go_to_the_more_frequent_language(spark):
    rows = [(k, "abc abc", "b" if k < 24 else "a") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.names == ("b", "a")
    # Of equal samples the first wins.
    assert langid.Parser(langid.Model(model.names, (b"abc abc",) * 2)).predict(["abc", "xyz"], 2)[0] == ["b", "b"]


@driver_tables
def test_predictions_are_those_of_plain_parsing(spark):
    """The query's rows for the held-out documents against substring search in the same samples."""
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet")
    model = langid.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.QUERIES["op5_language_id"](spark, SF.replace("0.01", "0.001")).where("held_out").collect():
        text = re.sub(b" +", b" ", langid.normal(texts[r["doc_id"]])).strip(b" ")
        if any(map(str.isalpha, texts[r["doc_id"]])) and len(text) < 4000:
            costs = [phrases(text, s) * math.log2(len(s) + 1) for s in model.samples]
            first, second = sorted(costs)[:2]
            assert r["lang_pred"] == model.names[costs.index(first)] and abs(r["score"] - (1 - first / second)) < 1e-9


def test_payloads_survive_the_store(rng):
    payloads = [jpeg_store.payload_of(t)[0] for t in (None, "", "a" * 192, "ÿ\xff" * 300, "x" * 600_000)]
    payloads += [rng.randbytes(1920), bytes([0, 255] * 96), bytes([255] * 192)]
    stored = jpeg_store.store(payloads)
    back = jpeg_store.read(stored)
    assert [b"".join(t.tobytes() for _, t in images) for images in back] == payloads
    assert len(back[4]) == 2
    for images in (back[2], back[5]):
        for frame, thumb in images:
            assert (jpeg_store._samples(jpeg_store._one_by_one(frame), frame) == thumb).all()
    with pytest.raises(ValueError):
        jpeg_store.frames(b"not a jpeg")


class Writer:
    """A plain JPEG writer with AC coefficients and several components, to test the reader."""

    DC = ([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12)))
    AC = ([0, 2, 1, 3, 2] + [0] * 11, [0x00, 0x01, 0xF0, 0x12, 0x02, 0x31, 0x03, 0x51])

    def __init__(self):
        self.bits = ""
        self.dc = {s: f"{c:0{n}b}" for s, c, n in jpeg_store.huffman(*self.DC)}
        self.ac = {s: f"{c:0{n}b}" for s, c, n in jpeg_store.huffman(*self.AC)}

    def number(self, value):
        size = abs(value).bit_length()
        return f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""

    def block(self, difference, rng):
        self.bits += self.dc[abs(difference).bit_length()] + self.number(difference)
        done = 0
        while done < 60 and rng.random() < 0.6:
            symbol = rng.choice(self.AC[1][1:])
            run, size = symbol >> 4, symbol & 15
            if done + run + 1 > 63:
                break
            done += run + 1
            self.bits += self.ac[symbol] + (self.number(rng.choice([-1, 1]) * rng.randrange(1 << size - 1, 1 << size)) if size else "")
        self.bits += self.ac[0] if done < 63 else ""

    def flush(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""


@pytest.mark.parametrize("components, interval", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2)], 4), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1)], 2)])
def test_reader_on_other_images(components, interval):
    rng, width, height, quant = random.Random(len(components) + interval), 50, 37, 16
    across, down = max(a for a, _ in components), max(d for _, d in components)
    single = len(components) == 1
    units_x = -(-width // 8) if single else -(-width // (8 * across))
    units_y = -(-height // 8) if single else -(-height // (8 * down))
    shapes = [(1, 1)] if single else components
    values = np.zeros((units_y * shapes[0][1], units_x * shapes[0][0]), int)
    writer, scan, before = Writer(), b"", [0] * len(shapes)
    for unit in range(units_x * units_y):
        if interval and unit and unit % interval == 0:
            scan += writer.flush() + bytes([255, 0xD0 + (unit // interval - 1) % 8])
            before = [0] * len(shapes)
        for k, (a, d) in enumerate(shapes):
            for y in range(d):
                for x in range(a):
                    value = rng.randrange(-64, 64)
                    writer.block(value - before[k], rng)
                    before[k] = value
                    if k == 0:
                        values[unit // units_x * d + y, unit % units_x * a + x] = value
    scan += writer.flush()
    seg = jpeg_store._segment
    data = (b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, quant]) + bytes([1]) * 63)
            + seg(0xC0, bytes([8, 0, height, 0, width, len(components)]) + b"".join(bytes([k, a << 4 | d, 0]) for k, (a, d) in enumerate(components, 1)))
            + seg(0xC4, bytes([0, *Writer.DC[0], *Writer.DC[1]])) + seg(0xC4, bytes([16, *Writer.AC[0], *Writer.AC[1]]))
            + (seg(0xDD, bytes([0, interval])) if interval else b"") + seg(0xDA, bytes([len(components)]) + b"".join(bytes([k, 0]) for k in range(1, len(components) + 1)) + bytes([0, 63, 0]))
            + scan + b"\xff\xd9")
    [frame] = jpeg_store.frames(data)
    [thumb] = jpeg_store.luminance([frame])
    h, w = -(-height // 8), -(-width // 8)
    assert (frame.width, frame.height) == (width, height)
    assert (thumb == np.clip(np.rint(values[: h if single else -(-height * shapes[0][1] // (8 * down)), : w if single else -(-width * shapes[0][0] // (8 * across))] * quant / 8) + 128, 0, 255)).all()


def test_media_rows(spark, table):
    rows = {r["doc_id"]: r for r in jpeg_store.media_columns(table(["same", "same", None, "é" * 200]), with_media=True).collect()}
    assert rows[0]["media"] == rows[1]["media"] and rows[0]["feature"] == rows[1]["feature"]
    payload = ("é" * 200).encode() + b" " * 176
    assert rows[3]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and rows[3]["n_bytes"] == 400 and rows[3]["payload_bytes"] == 576
    assert rows[3]["tail_crc32"] == zlib.crc32(payload[-16:]) and rows[2]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()
    assert rows[3]["media_sha256"] == hashlib.sha256(rows[3]["media"]).hexdigest() and rows[3]["media_bytes"] == len(rows[3]["media"])
