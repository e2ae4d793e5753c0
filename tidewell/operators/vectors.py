"""The vector table: texts embedded in Arrow batches, saved, loaded and checked."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 768
#: Texts embedded at once.
BATCH = 256

#: Turns texts into one vector each; what it needs is loaded by the function that makes it, once per task.
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """A deterministic embedder that needs no model: signed counts of hashed words."""
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[(h >> 1) % dimensions] += 1 if h & 1 else -1
        return out

    return embed


def embed(df: DataFrame, text: Column, make: Callable[[], Embedder], name: str = "vec") -> DataFrame:
    """``df`` with unit vectors of a text column; null for an empty text."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            out: list = []
            for at in range(0, len(texts), BATCH):
                part = texts.iloc[at: at + BATCH].fillna("").tolist()
                vectors = np.asarray(model(part), np.float32)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = vectors / np.where(norms > 0, norms, 1)
                out += [v.tolist() if t.strip() else None for t, v in zip(part, unit)]
            yield pd.Series(out)

    return df.withColumn(name, run(text))


def build(docs: DataFrame, text: Column, make: Callable[[], Embedder] = hashing_embedder, id_col: str = "id") -> DataFrame:
    """``(doc_id, vec)`` of the documents that have an id and a text."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where((F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
    return embed(chosen, F.col("text"), make).select("doc_id", "vec")


def save(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def check(vectors: DataFrame) -> DataFrame:
    """One row: how many vectors, how many distinct ids, the shortest and longest vector, bytes as 32-bit floats."""
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_ids"), F.min(F.size("vec")).cast("long").alias("least_dimensions"),
                       F.max(F.size("vec")).cast("long").alias("most_dimensions"), (F.sum(F.size("vec")) * 4).cast("long").alias("n_bytes"))
