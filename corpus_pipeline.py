"""The corpus pipeline: five operators applied in turn to ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. The first four return the
columns of ``documents``; the last returns where each piece of each remaining document is packed.

Defined cases are those of the operators. A document is rejected by the first stage only if no language can be
determined: its text is null or has no letter, or is foreign to all learned languages (``langid.FOREIGN``). Of rows that repeat an id each is treated as a document of
its own, but identical ones (and near copies) leave one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, jaccard, langid, packing, pii
from tidewell.llm.common import cut, documents, free_name, new_path, numbered, remove, small, tokenizer_file, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    predicted, score, foreign = (free_name(docs, n) for n in ("predicted_lang", "predicted_score", "predicted_foreign"))
    found = langid.identify(docs, langid.fit(docs), lang_as=predicted, score_as=score, foreign_as=foreign)
    return found.where((F.col(predicted) != langid.UNDETERMINED) & ~F.col(foreign)).drop(predicted, score, foreign)


def _without(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose numbers ``dropped`` holds."""
    return docs.join(small(dropped.withColumnRenamed("row", row)), row, "left_anti").drop(row)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = free_name(docs, "row")
    rows = numbered(docs, row)
    flags = exact_dedup.exact_duplicates(rows, keep="largest", row_col=row)
    return _without(rows, row, cut(flags.where("not kept").select("row")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = free_name(docs, "row")
    rows = numbered(docs, row)
    return _without(rows, row, cut(jaccard.near_duplicates(rows, row)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json")).drop("row")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("pii", personal_data),
    ("best_fit_packing", packing_stage),
]

#: Near-duplicate joins, sanitisation and packing aren't expressible in SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        # Each stage's rows are written to the shared folder as parquet and read again; then those before can go.
        path = new_path(spark, name)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    result = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, before)
    return result
