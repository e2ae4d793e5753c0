"""Exact deduplication by a 128-bit content hash, with a byte comparison inside the groups.

Only DataFrame functions are used. Texts are equal when identical after lower-casing A-Z.

* One pass hashes every whole text; only ids and hashes are kept and shuffled.
* A group's size and the id that stays come from a partially aggregated ``max``/``count``,
  so a hot group never meets in one task.
* Texts of groups with two or more rows are then compared with the text of the row that
  stays. The rows of a group of more than ``SALT`` are dealt over several keys, and the one
  text they are compared with is copied to each. Rows that differ (a hash collision) are grouped again by their text.

Rows are told apart by numbers that don't depend on how a scan is dealt over tasks (``common.numbered``).

Defined cases: a null text counts as empty; a row with a null id stays only if no row of its group has an id; of rows that
repeat the same id and text one stays; an empty table gives an empty result; further columns
of the input are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, free_name, numbered, small

#: Rows of a group that are compared under one key.
SALT = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept; null gives the empty string."""
    text = F.coalesce(text, F.lit(""))
    # lower() folds only A-Z in a string of single bytes, and is many times faster than translate().
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                     row_col: str | None = None, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: its id, the id that stays, the group's size, and whether this row stays.

    ``keep`` is "smallest" or "largest" (id). ``row_col`` names a unique column of ``docs`` that breaks
    ties between rows of equal id and is returned as ``row``, and must be the same whenever ``docs`` is read; by default the rows are numbered.
    ``hashed`` may be replaced to test collisions.
    """
    if row_col is None:
        row_col = free_name(docs, "row")
        docs = numbered(docs, row_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(row_col).alias("row"), ascii_lower(F.col(text_col)).alias("norm")).withColumn("hash", hashed(F.col("norm")))
    rows = cut(texts.select("id", "row", "hash", F.sha2("norm", 256).alias("text_sha256")))

    best = F.max if keep == "largest" else F.min
    # max() takes a null id only if there's no other; min() would prefer it.
    order = F.struct("id", "row") if keep == "largest" else F.struct(F.isnull("id").alias("none"), "id", "row")

    def grouped(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(best(order).alias("top"), F.count(F.lit(1)).alias("group_size")).select(
            *keys, F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size")

    groups = cut(grouped(rows, "hash"))
    several = groups.where("group_size > 1").select("hash", "keep_row", F.ceil(F.col("group_size") / SALT).alias("salts"))
    hot = cut(several.where("salts > 1").select("hash", "salts"))
    if hot.isEmpty():
        salted = texts.withColumn("salt", F.lit(0))
    else:
        # At most a row for each SALT rows of the table.
        salted = texts.join(small(hot), "hash", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = several.select("hash", "keep_row", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"), "salts")
    compared = salted.join(small(copies), ["hash", "salt"])
    stays = compared.where("row = keep_row").select("hash", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"))
    collided = cut(compared.where("row <> keep_row").join(stays, ["hash", "salt"]).where("norm <> kept_norm").select("row", F.col("norm").alias("other")))
    if not collided.isEmpty():
        rows = cut(rows.join(collided, "row", "left"))
        groups = cut(grouped(rows, "hash", "other"))
        same = F.col("l.other").eqNullSafe(F.col("g.other"))
    else:
        same = F.lit(True)
    return rows.alias("l").join(groups.alias("g"), (F.col("l.hash") == F.col("g.hash")) & same).select(
        F.col("l.id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row")
