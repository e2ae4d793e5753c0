"""The pipeline's stages against plain versions on small tables."""

import os
import re

import numpy as np
import pytest

import corpus_pipeline
from tidewell.llm import jaccard, pii

SF = "/root/testdata/sf0.001"
driver_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]


def test_each_stage_takes_effect(spark, table, rng):
    words = ["".join(rng.choice("etaoins") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(12)]
    near = texts[0].split(" ")
    near[200] = "changed"
    docs = table(texts + [texts[1].upper(), " ".join(near), "12345 !", None, texts[2] + " reach me at someone@corp.example.com"])
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == set(range(17)) - {14, 15}
    kept = stages["exact_dedup"](spark, kept, "")
    assert {r["doc_id"] for r in kept.collect()} == set(range(17)) - {1, 14, 15}
    kept = stages["simhash_near_dedup"](spark, kept, "")
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(range(12)) - {1} <= left.keys() and 12 in left and 13 not in left
    masked = {r["doc_id"]: r["text"] for r in stages["pii"](spark, kept, "").collect()}
    assert masked.keys() == left.keys() and all(masked[k] == left[k] for k in left if k < 12)
    assert not any("someone@corp" in t for t in masked.values())


@driver_tables
def test_whole_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    last = {re.sub("[A-Z]", lambda m: m[0].lower(), texts[k]): k for k in sorted(texts)}
    packed = {r["doc_id"] for r in rows}
    # Exact copies leave their last, as the query does; of what is similar the smallest is left: by brute force over all pairs.
    accepted = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, spark.read.parquet(f"{SF}/documents.parquet"), "").select("doc_id").collect()}
    last = {re.sub("[A-Z]", lambda m: m[0].lower(), texts[k]): k for k in sorted(accepted)}
    ids = sorted(last.values())
    kept = components_by_jaccard([texts[k] for k in ids])
    assert packed == {ids[n] for n in kept} and len(packed) >= 0.95 * len(last)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
    assert all(not pii.base_spans(pii.masked(t, pii.base_spans(t))) for t in texts.values())


def shingles_of(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))}


def components_by_jaccard(texts):
    sets, label = [shingles_of(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if c in (x, y) else c for c in label]
    return set(label)


def test_near_stage_finds_every_pair_of_high_jaccard(spark, table, rng):
    """Copies with edits down to 0.8, a chain of them, and a large group: as by brute force."""
    words = ["".join(rng.choice("etaoins") for _ in range(5)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
    for k in range(20):
        for edits in range(1, 6):
            copy = texts[k].split(" ")
            for at in rng.sample(range(200), edits):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[0] + f" end {k}" for k in range(60)] + ["a b", "A  b", "a c"]
    chain = [rng.choice(words) for _ in range(200)]
    for k in range(12):
        texts.append(" ".join(chain[9 * k:] + [f"new{n}" for n in range(9 * k)]))
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, table(texts), "")
    want = components_by_jaccard(texts)
    assert {r["doc_id"] for r in kept.collect()} == want and len(want) < len(texts) - 100


@pytest.mark.parametrize("part_keys", [1 << 20, 50])
def test_keys_are_dealt_out_once(spark, table, rng, monkeypatch, part_keys):
    """No table of all keys is written, and rows that share enough keys still share one, in one part or many."""
    monkeypatch.setattr(jaccard, "written", lambda *_: pytest.fail("a table was written"))
    words = ["".join(rng.choice("etaoins") for _ in range(5)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((9, 60, 200)))) for _ in range(40)]
    texts += [t.replace(t.split(" ")[5], "changed", 1) for t in texts[:20]] + [texts[0] + f" end {k}" for k in range(9)] + ["", "?", None]
    docs = table(texts)
    held = {}
    for r in jaccard.members(docs, "doc_id", "text", part_keys=part_keys).collect():
        held.setdefault(r["row"], set()).add(r["key"])
    common, every = jaccard.commonness(docs, "text")
    sets = [jaccard.shingles(t) for t in texts]
    keys = [set(jaccard.first_keys(s, common).tolist()) for s in sets]
    assert every == sum(map(len, keys))
    close = {(a, b) for a in range(len(texts)) for b in range(a) if len(keys[a] & keys[b]) >= max(jaccard.least_shared(len(sets[k])) for k in (a, b))}
    assert len(close) > 40 and all(held[a] & held[b] for a, b in close)
    shared = [{k for k in own if sum(k in other for other in keys) > 1} for own in keys]
    assert all(len(shared[row]) >= jaccard.least_shared(len(sets[row])) for row in held) and len(held) < len(texts)


def test_dealt_keys_take_few_bytes(rng):
    """A key used to take about eleven bytes in a table and as many in each of two shuffles."""
    keys = [np.array([rng.getrandbits(64) for _ in range(150)], np.uint64) for _ in range(2000)]
    dealt = jaccard.dealt([(3 * k, 40, own) for k, own in enumerate(keys)], 30)
    parts = list(zip(*(dealt.column(k).to_pylist() for k in range(3))))
    assert sum(len(data) for _, _, data in parts) <= 6.5 * sum(map(len, keys))
    found = [(part, *x) for part, n, data in parts if part >= 0 for x in zip(*(c.tolist() for c in jaccard.unpacked(data, n)))]
    want = [(((k & (1 << 56) - 1) >> 24) * 30 >> 32, k & (1 << 40) - 1, 3 * row) for row, own in enumerate(keys) for k in own.tolist()]
    assert sorted(found) == sorted(want)
    (part, n, data), = [x for x in parts if x[0] < 0]
    least, rows = jaccard.unpacked(data, n)
    assert least.tolist() == [40] * 2000 and rows.tolist() == [3 * k for k in range(2000)]
