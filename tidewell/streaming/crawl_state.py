"""Crawl progress as an append-only event table, from which what is done and where to go on is derived.

Events: ``(seq, platform, category, page, done)``. A page event says that a category was read up to ``page``; a done
event completes it. Only the last event counts as the place to go on from, as only one category is in progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "seq long, platform string, category string, page int, done boolean"


def completed(events: DataFrame) -> DataFrame:
    return events.where("done").select("platform", "category").distinct()


def current(events: DataFrame) -> DataFrame:
    """One row: the category in progress and its last page; after a done event null and 0."""
    last = events.agg(F.max_by(F.struct("platform", "category", "page", "done"), "seq").alias("x"))
    going = F.coalesce(~F.col("x.done"), F.lit(False))
    return last.select(F.when(going, F.col("x.platform")).alias("platform"), F.when(going, F.col("x.category")).alias("category"),
                       F.when(going, F.col("x.page")).otherwise(0).alias("page"))


def to_do(categories: DataFrame, events: DataFrame) -> DataFrame:
    """Categories that aren't completed, with the page to go on from (0: the beginning)."""
    at = F.broadcast(current(events)).withColumnRenamed("page", "resume_page")
    left = categories.join(completed(events), ["platform", "category"], "left_anti")
    return left.join(at, ["platform", "category"], "left").withColumn("resume_page", F.coalesce("resume_page", F.lit(0)))


def stats(events: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: distinct ids seen, completed categories, and the place in progress."""
    counts = seen.agg(F.countDistinct("id").alias("total_crawled_products"))
    done = completed(events).agg(F.count(F.lit(1)).alias("completed_categories"))
    place = current(events).select(F.col("category").alias("current_category"), F.col("page").alias("last_page"))
    return counts.crossJoin(done).crossJoin(place)
