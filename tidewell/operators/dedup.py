"""Keeping one record of each id, unseen records, and counts by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _best(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    # max_by aggregates partially, so copies of a hot id never meet in one task.
    kept = df.groupBy(*[F.col(k).alias(f"_key_{n}") for n, k in enumerate(keys)]).agg(F.max_by(F.struct(*df.columns), order).alias("kept"))
    return kept.select("kept.*")


def keep_latest(df: DataFrame, keys: list[str], time: str, position: str) -> DataFrame:
    """The row of each key with the greatest time (missing counts as empty); of equals the first by position. Rows without a key go."""
    with_key = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    when = F.coalesce(F.col(time).cast("string"), F.lit(""))
    return _best(with_key, keys, F.struct(when, -F.col(position).cast("long")))


def keep_first(df: DataFrame, keys: list[str], *positions: str) -> DataFrame:
    """The first row of each key in the order of ``positions`` (file before place in it, say)."""
    return _best(df, keys, F.struct(*(-F.col(p).cast("long") for p in positions)))


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows with a key that ``seen`` lacks; of rows with equal keys all stay, rows without a key go."""
    return df.where(F.col(key).isNotNull()).join(seen.select(key).distinct(), key, "left_anti")


def count_by_source(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def report(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows before and after deduplication by file, and the total (``by`` is null)."""
    key = F.struct(*keys)
    valid = F.when(F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull(), None).otherwise(key)
    # One row for each file and key first, so the distinct count needs no second expansion.
    each = df.groupBy(by, valid.alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy(by).agg(F.sum("n").alias("before"), F.count("_key").alias("after"))
    rolled = found.rollup(by).agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    removed = F.col("before") - F.col("after")
    return rolled.withColumn("removed", removed).withColumn("percent", F.round(removed * 100.0 / F.col("before"), 2))
