"""Personal data: patterns, and terms that reveal them by information-theoretic sanitisation.

Patterns find e-mail addresses, IP addresses, card and phone numbers in whole texts. Each value found is a protected
entity a; the terms (runs of letters and digits) of the documents that hold it are candidates c. Over all documents n(a),
n(c) and n(a, c) are counted; with N documents, PMI(a; c) = log(N n(a,c) / (n(a) n(c))) is the information c gives
about a, out of IC(a) = log(N / n(a)). In the texts that hold an entity, each occurrence of a term that gives at least
``GENERALISE`` of its information is generalised, at least ``REMOVE`` removed, provided that the term occurs in ``SUPPORT``
documents: a term of one document leads to no other text, and in its own the value is masked. An entity may be seen
in one document only. Documents without entities are left alone. A generalised term gives way to its kind, as far as its form and its
neighbours show it (``general``): a number, a code, a person, an organisation, a place, a name or a word.

The counts are partially aggregated over all documents. As n(a, c) is at most n(a), a term of more than
N^(1-g) n(a)^g documents can't disclose a share g; such pairs, nearly all, aren't made. Entities that occur in exactly the same rows disclose
alike, as do terms; one of each such class stands for all, so a log of many addresses doesn't make a pair of each with each term.
No text or count of pairs is collected.

Defined cases: a null text counts as empty; matches that fail their check are dropped without retrying; rows that
repeat an id are searched each for itself and counted as documents; an empty table gives an empty result; further
columns are ignored by ``find`` and kept by ``sanitise``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import cut, free_name, modest_batches, numbered, release, small, texts_of

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")
SUPPORT, GENERALISE, REMOVE = 2, 0.75, 0.95
#: Terms of one letter count too (names in scripts without spaces are short).
SHORTEST_TERM = 1
#: Distinct terms that a task counts before it passes the counts on.
TERMS_HELD = 200_000

# The local part is looked up backwards from the @, so that long runs without one cost nothing.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(rf"[^\W_]{{{SHORTEST_TERM},}}")
#: Doubled digits of the Luhn sum.
LUHN = [2 * d - 9 * (d > 4) for d in range(10)]

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    numbers = list(map(int, digits))
    return (sum(numbers[-1::-2]) + sum(LUHN[d] for d in numbers[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, free = [], 0
    for m in AT_DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            free = m.end()
            found.append((start, free))
    return found


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of each match, sorted; kinds are numbered as in ``KINDS``."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        # Longer parts than three digits may still be small if they begin with zeros.
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def entity(kind: int, value: str) -> str:
    """What spellings of one protected value have in common."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else re.sub('[^0-9]', '', value)}"


def entities(text: str, spans: list[Span]) -> list[str]:
    return sorted({entity(kind, text[start:end]) for start, kind, end in spans})


def terms(text: str, spans: list[Span]) -> list[tuple[str, int, int]]:
    """(term, start, end) of each term outside the matches."""
    found, at, taken = [], 0, 0
    for m in TERM.finditer(text):
        # taken: the furthest end of the matches that begin before the term's end.
        while at < len(spans) and spans[at][0] < m.end():
            taken = max(taken, spans[at][2])
            at += 1
        if m.start() >= taken:
            found.append((m[0].lower(), m.start(), m.end()))
    return found


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())])
NEAR = T.StructType([T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
ARROW_NEAR = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scanned(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """``(id, row, spans, entities, near)`` of each row; near: the terms of rows with entities."""
    modest_batches(docs)
    chosen = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([chosen.schema[0], chosen.schema[1], T.StructField("spans", T.ArrayType(SPAN)),
                           T.StructField("entities", T.ArrayType(T.StringType())), T.StructField("near", T.ArrayType(NEAR))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            spans, names, near = [], [], []
            for text in texts_of(batch.column(2)):
                text = text or ""
                own = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
                names.append(entities(text, own))
                near.append([dict(zip(("term", "start", "end"), x)) for x in terms(text, own)] if own else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, ARROW_SPAN), pa.array(names, pa.list_(pa.string())),
                                              pa.array(near, ARROW_NEAR)], names=schema.names)

    return chosen.mapInArrow(run, schema)


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``(term, n_term)``: in how many documents each term occurs, within matches or outside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in texts_of(batch.column(0)):
                held.update({x.lower() for x in set(TERM.findall(text or ""))})
                if len(held) >= TERMS_HELD:
                    yield passed()
                    held.clear()
        yield passed()

    return docs.select(text_col).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


#: pairs: ``(row, entity, term, n_entity, n_term)`` of those that stand for their class; entities: ``(entity, stands)``;
#: words: ``(row, term, stands, n_term)`` of the terms that may disclose anything.
Candidates = namedtuple("Candidates", "pairs entities words")


def _classes(held: DataFrame, name: str, count: Column) -> DataFrame:
    """``(name, stands, n)``: the least value that occurs in exactly the same rows (by 128 bits of a sum that doesn't depend on order)."""
    each = held.groupBy(name).agg(count.alias("n"), F.count(F.lit(1)).alias("held"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    each = cut(each)
    keys = ["n", "held", "x", "y"]
    return cut(each.join(each.groupBy(*keys).agg(F.min(name).alias("stands")), keys).select(name, "stands", "n"))


def candidates(docs: DataFrame, found: DataFrame, text_col: str, support: int = SUPPORT, generalise: float = GENERALISE) -> Candidates:
    """The pairs of entities and terms that may disclose enough."""
    total = found.count()
    near = found.where(F.size("spans") > 0)
    held = near.select("row", F.explode("entities").alias("entity"))
    entities = _classes(held, "entity", F.count(F.lit(1)))
    most = entities.agg(F.max("n")).first()[0] or 0
    each = held.join(small(entities.where("entity = stands").select("entity", F.col("n").alias("n_entity"))), "entity")
    # Slightly more than the bound, as rounding may go either way.
    bound = F.lit(1.000001 * total ** (1 - generalise))
    counts = cut(term_counts(docs, text_col).where((F.col("n_term") >= support) & (F.col("n_term") <= bound * float(most) ** generalise)))
    words = cut(near.select("row", F.explode(F.array_distinct(F.transform("near", lambda x: x["term"]))).alias("term")).join(small(counts), "term"))
    classes = _classes(words, "term", F.first("n_term"))
    words = cut(words.join(small(classes.select("term", "stands")), "term").select("row", "term", "stands", "n_term"))
    pairs = each.join(words.where("term = stands"), "row").where(F.col("n_term") <= bound * F.pow(F.col("n_entity").cast("double"), F.lit(generalise)))
    return Candidates(cut(pairs.select("row", "entity", "term", "n_entity", "n_term")), entities.select("entity", "stands"), words)


def class_disclosures(pairs: DataFrame, total: float, generalise: float = GENERALISE) -> DataFrame:
    """``(entity, term, disclosure)`` of the classes whose term reveals at least ``generalise`` of the entity's information."""
    joined = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    pmi = F.log(F.lit(total) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    content = F.log(F.lit(total) / F.col("n_entity"))
    return joined.select("entity", "term", F.when(content > 0, pmi / content).otherwise(0.0).alias("disclosure")).where(F.col("disclosure") >= generalise)


def disclosing(docs: DataFrame, found: DataFrame, text_col: str, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """``(entity, term, disclosure)`` of the terms that reveal at least ``generalise`` of an entity's information, for a report: every entity with every term."""
    own = candidates(docs, found, text_col, support, generalise)
    classes = class_disclosures(own.pairs, float(found.count()), generalise).select(F.col("entity").alias("of_entity"), F.col("term").alias("of_term"), "disclosure")
    terms = own.words.select("term", "stands").distinct()
    return classes.join(own.entities, F.col("of_entity") == own.entities["stands"]).drop("stands").join(terms, F.col("of_term") == terms["stands"]).select("entity", "term", "disclosure")


def term_spans(found: DataFrame, own: Candidates, disclosed: DataFrame, remove: float = REMOVE) -> DataFrame:
    """``(row, terms)``: the places in each row of terms to generalise (kind 0) or remove (kind 1)."""
    # A term that reveals several entities is treated by the strongest disclosure.
    hit = own.pairs.join(disclosed, ["entity", "term"]).groupBy("row", F.col("term").alias("stands")).agg(F.max("disclosure").alias("d"))
    every = own.words.join(hit, ["row", "stands"]).select("row", "term", "d")
    each = found.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*").join(every, ["row", "term"])
    one = F.struct("start", F.when(F.col("d") >= remove, 1).otherwise(0).alias("kind"), "end")
    return each.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("terms"))


def _searched(docs: DataFrame, id_col: str, text_col: str, row: Column, support: int, generalise: float, remove: float) -> tuple[DataFrame, DataFrame]:
    found = cut(scanned(docs, id_col, text_col, row))
    own = candidates(docs, found, text_col, support, generalise)
    disclosed = cut(class_disclosures(own.pairs, float(found.count()), generalise))
    return found, cut(term_spans(found, own, disclosed, remove))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of ``docs``: its id, matches by kind, a digest of the matches, all spans (terms included), and how many terms and spans."""
    # The numbers are made once, as what was found is cut.
    found, terms = _searched(docs, id_col, text_col, F.monotonically_increasing_id(), support, generalise, remove)
    both = found.select("id", "row", "spans").join(small(terms), "row", "left")
    schema = T.StructType([found.schema["id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_terms", T.LongType()),
                           T.StructField("n_found", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*KINDS, *TERM_KINDS]
        for batch in batches:
            out = []
            for spans, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [(x["start"], x["kind"], x["end"]) for x in spans]
                every = sorted(own + [(x["start"], len(KINDS) + x["kind"], x["end"]) for x in more or []])
                by_kind = Counter(k for _, k, _ in own)
                out.append((*(by_kind[n] for n in range(len(KINDS))), hashlib.sha256(digest(own).encode()).hexdigest(),
                            ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in every), len(every) - len(own), len(every)))
            types = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types))], names=schema.names)

    return both.select("id", "spans", "terms").mapInArrow(run, schema).withColumnRenamed("id", id_col)


MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", None, "")
GENERALISED = 4

# What stands before a person's or a place's name, and after an organisation's or a place's.
PERSON_BEFORE = frozenset("mr mrs ms dr prof herr frau m mme mlle monsieur madame sr sra señor señora don doña".split())
PLACE_BEFORE = frozenset("in at near from city town rue avenue place calle plaza avenida stadt bei nach".split())
ORGANISATION_AFTER = frozenset("inc ltd llc plc corp co company corporation gmbh ag kg sa sarl sas sl university bank".split())
PLACE_AFTER = frozenset("street st road rd avenue ave lane square city county strasse straße platz".split())
NEXT, BEFORE = re.compile(r"\W{1,2}([^\W\d_]+)"), re.compile(r"([^\W\d_]+)\W{1,2}\Z")
#: Characters before a term in which its neighbour is looked for.
NEIGHBOUR = 24


def general(text: str, start: int, end: int) -> str:
    """The kind of a term, by its form and the words beside it, that is written in its place."""
    term = text[start:end]
    if any(map(str.isdigit, term)):
        return "[NUMBER]" if term.isdigit() else "[CODE]"
    if not term[0].isupper():
        return "[WORD]"
    before, after = BEFORE.search(text[max(0, start - NEIGHBOUR): start]), NEXT.match(text, end)
    before, after = (m[1].lower() if m else "" for m in (before, after))
    if after in ORGANISATION_AFTER:
        return "[ORGANISATION]"
    if before in PERSON_BEFORE:
        return "[PERSON]"
    return "[PLACE]" if after in PLACE_AFTER or before in PLACE_BEFORE else "[NAME]"


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind's mark (a generalised term's kind is that of the term); of spans that overlap the first gives the mark."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], general(text, start, end) if kind == GENERALISED else MARKS[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with personal data masked in the text, and disclosing terms generalised or removed; all columns and rows stay."""
    row, more = free_name(docs, "row"), free_name(docs, "terms")
    rows = numbered(docs, row)
    _, terms = _searched(rows, id_col, text_col, F.col(row), support, generalise, remove)
    joined = rows.join(small(terms.select(F.col("row").alias(row), F.col("terms").alias(more))), row, "left").drop(row)
    place, last, names = joined.columns.index(text_col), len(joined.columns) - 1, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, terms in zip(texts_of(batch.column(place)), batch.column(last)):
                texts.append(masked(text, base_spans(text or "") + [(x["start"], len(KINDS) + x["kind"], x["end"]) for x in terms.as_py() or []]))
            columns = list(batch.columns[:last])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
