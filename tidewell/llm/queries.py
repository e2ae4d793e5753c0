"""The corpus queries: each applies one operator to the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, exact_dedup, jpeg_store, langid, license_scan, packing, pii, simhash, token_matrix, wordpiece
from tidewell.llm.common import documents, tokenizer_file


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json")).drop("row")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="largest").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op2_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_store.media_columns(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    texts = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.identify(texts, langid.fit(docs)).drop("text", "foreign")


def op10_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix.matrix(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_wordpiece_counts": op2_wordpiece_counts,
    "op3_license_scan": op3_license_scan,
    "op4_media_columns": op4_media_columns,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_matrix": op10_token_matrix,
}

ORACLE_SQL = {
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
}
