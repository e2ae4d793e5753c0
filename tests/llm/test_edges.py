"""Every operator and stage on awkward tables: nulls, empty and very long texts, repeated rows, clashing names, no rows."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.llm import bpe, exact_dedup, jpeg_store, langid, license_scan, packing, pii, simhash, token_matrix, wordpiece
from tidewell.llm.common import tokenizer_file

BYTES, WORDS, PIECES = (tokenizer_file(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
OPERATORS = {
    "pii": pii.find, "wordpiece": lambda d: wordpiece.token_counts(d, PIECES), "license": license_scan.license_scan, "jpeg": jpeg_store.media_columns,
    "langid": lambda d: langid.identify(d.select("doc_id", "text"), langid.fit(d)), "simhash": simhash.near_duplicates, "bpe": lambda d: bpe.digests(d, BYTES),
    "bpe_full": lambda d: bpe.encoded(d, BYTES), "packing": lambda d: packing.packed(d, WORDS), "exact": exact_dedup.exact_duplicates, "matrix": lambda d: token_matrix.matrix(d, BYTES)}
#: Operators that return one row for each row.
ROW_BY_ROW = {"pii", "wordpiece", "jpeg", "langid", "simhash", "bpe", "bpe_full", "exact"}


def awkward(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (3, " \n\t ", "en", "s", 4), (None, "null id, a@b.cd", "en", None, 1),
            (None, None, None, None, None), (4, "x" * 70_000, "en", "s", 1), (5, "word " * 30_000, "de", "s", 1), (6, "the cat sat on the mat", "en", "s", 1),
            (7, "The cat sat on the mat", "en", "s", 1), (8, "日本語 ñ é \u0000 😀 <|endoftext|>", None, "s", 1), (-5, "12 34", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Names that operators use themselves.
    clashing = ("id", "row", "hash", "fp", "terms", "rank", "length", "score", "Row", "label", "lang_pred", "bucket")
    return df.withColumns({("_" if n == "Row" else "") + n: F.lit("other") for n in clashing})


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    df = awkward(spark)
    got = OPERATORS[name](df)
    rows = got.collect()
    if name in ROW_BY_ROW:
        assert len(rows) == df.count()
        assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    # The result can be written as it is.
    got.write.format("noop").mode("overwrite").save()


def test_awkward_values(spark):
    """What the operators give for each awkward row, not only that they give something."""
    df = awkward(spark)
    library = Tokenizer.from_file(BYTES)
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect() if r["doc_id"] not in (None, 3)}
    got = {r["doc_id"]: r for r in OPERATORS["bpe"](df).collect()}
    assert all(got[k]["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids) for k, t in texts.items())
    assert all(got[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items())
    sizes = Counter((r["doc_id"], r["group_size"], r["kept"]) for r in OPERATORS["exact"](df).collect())
    # Null and empty texts are alike, the row with an id stays; of two rows alike in id and text one stays; the cats are alike, the smallest id stays.
    assert sizes[1, 3, True] == 1 and sizes[2, 3, False] == 1 and sizes[None, 3, False] == 1 and sizes[None, 1, True] == 1
    assert sizes[3, 2, True] == sizes[3, 2, False] == 1 and sizes[6, 2, True] == sizes[7, 2, False] == 1
    found = {r["doc_id"]: r for r in OPERATORS["pii"](df).where("doc_id IS NULL").collect()}
    assert found[None]["n_ip"] == 0 and sorted(r["n_email"] for r in OPERATORS["pii"](df).where("doc_id IS NULL").collect()) == [0, 1]
    assert {r["doc_id"]: r["lang_pred"] for r in OPERATORS["langid"](df).where("doc_id IN (1, 2, -5)").collect()} == {1: "und", 2: "und", -5: "und"}
    assert {r["doc_id"] for r in OPERATORS["matrix"](df).select(F.explode("doc_ids").alias("doc_id")).collect()} == {None, 3, 4, 5, 6, 7, 8, -5}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](awkward(spark).limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_stages(spark, kind):
    docs = awkward(spark)
    docs = docs.limit(0) if kind == "empty" else docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    if kind == "empty":
        assert packed.collect() == []
    else:
        # One of the cats is left; texts without letters and those like nothing learned are rejected (a run of x is like no row that is learned from).
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left == {None, 7} and {r["doc_id"] for r in packed.select("doc_id").collect()} == left
        assert docs.where("doc_id IS NULL").first()["text"] == "null id, [EMAIL]"


@pytest.mark.parametrize("count", [1, 2])
def test_few_rows(spark, table, count):
    docs = table(["only one document with the words"] * count)
    assert exact_dedup.exact_duplicates(docs).where("kept").count() == 1
    assert simhash.near_duplicates(docs).where("kept").count() == 1
