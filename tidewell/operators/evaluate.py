"""Retrieval metrics over batches of ranked lists.

retrieved: ``(query_id, doc_id, rank)`` with ranks from 1; qrels: ``(query_id, doc_id)``, repeated pairs count once, or only ``(doc_id)`` if the same documents
are relevant to all queries.
A query of ``queries`` without results or without relevant documents scores 0 where its measure is undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(retrieved: DataFrame, qrels: DataFrame) -> DataFrame:
    """``retrieved`` with ``hit``: whether the document is relevant."""
    keys = [c for c in ("query_id", "doc_id") if c in qrels.columns]
    relevant = qrels.select(*keys).distinct().withColumn("hit", F.lit(True))
    return retrieved.join(relevant, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


#: The shorter list whose precision reports show besides.
SHORT = 5


def metrics(queries: DataFrame, retrieved: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query: ``precision``, ``recall``, ``f1``, ``ndcg`` at k, ``precision_short``, and ``reciprocal_rank`` over the whole list."""
    inside = F.col("rank") <= k
    per_query = judged(retrieved, qrels).groupBy("query_id").agg(
        F.sum(F.when(inside & F.col("hit"), 1).otherwise(0)).alias("hits"),
        F.sum(F.when((F.col("rank") <= SHORT) & F.col("hit"), 1).otherwise(0)).alias("short_hits"),
        F.sum(F.when(inside & F.col("hit"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"))
    known = queries.select("query_id").join(per_query, "query_id", "left")
    if "query_id" in qrels.columns:
        relevant = qrels.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
        known = known.join(relevant, "query_id", "left")
    else:
        known = known.crossJoin(F.broadcast(qrels.agg(F.countDistinct("doc_id").alias("n_relevant"))))
    joined = known.fillna(0, ["hits", "short_hits", "dcg", "n_relevant"])
    hits, n = F.col("hits"), F.col("n_relevant")
    precision = hits / F.lit(k) if k > 0 else F.lit(0.0)
    recall = F.when((n > 0) & F.lit(k > 0), hits / n).otherwise(0.0)
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n.cast("int"), F.lit(max(k, 1))))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    both = joined.select("query_id", "n_relevant", precision.cast("double").alias("precision"), (F.col("short_hits") / SHORT).alias("precision_short"), recall.alias("recall"),
                         F.when((n > 0) & F.lit(k > 0), F.col("dcg") / best).otherwise(0.0).alias("ndcg"),
                         F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return both.withColumn("f1", f1)


MEASURES = ("precision_short", "precision", "recall", "f1", "ndcg")


def details(measured: DataFrame) -> DataFrame:
    """Per-query values as a report shows them: rounded to four places."""
    return measured.select("query_id", *(F.round(m, 4).alias(m) for m in MEASURES), "reciprocal_rank")


def summary(measured: DataFrame, digits: int = 4) -> DataFrame:
    """Means of the rounded values, and the mean reciprocal rank of unrounded ones, rounded to ``digits`` places; 0 for no queries."""
    def mean(name: str) -> Column:
        return F.round(F.coalesce(F.avg(name), F.lit(0.0)), digits)

    return details(measured).agg(F.count(F.lit(1)).alias("n_queries"), *(mean(m).alias(f"avg_{m}") for m in MEASURES), mean("reciprocal_rank").alias("mrr"))


def compare(first: DataFrame, second: DataFrame, digits: int = 4) -> DataFrame:
    """Two summaries measure by measure: ``(measure, first, second, difference, trend)``."""
    names = [*(f"avg_{m}" for m in MEASURES), "mrr"]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).alias(name)) for n in names))).alias("x")).select("x.*")

    both = long(first, "first").join(long(second, "second"), "measure")
    difference = F.round(F.col("second") - F.col("first"), digits)
    return both.withColumn("difference", difference).withColumn("trend", F.when(difference > 0, "up").when(difference < 0, "down").otherwise("same"))


def pseudo_ground_truth(queries: DataFrame, hits: DataFrame, shown: int = 20, relevant: int = 5) -> DataFrame:
    """Per query the first ``shown`` results, of which the first ``relevant`` count as relevant."""
    entry = F.struct("rank", "doc_id", (F.col("rank") <= relevant).alias("is_relevant"))
    lists = hits.where(F.col("rank") <= shown).groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("all_results"))
    none = F.array().cast(lists.schema["all_results"].dataType)
    joined = queries.join(lists, "query_id", "left").withColumn("all_results", F.coalesce("all_results", none))
    return joined.withColumn("relevant_docs", F.transform(F.filter("all_results", lambda x: x["is_relevant"]), lambda x: x["doc_id"]))


def qrels_of(ground_truth: DataFrame) -> DataFrame:
    """``(query_id, doc_id)`` of a ground-truth document's queries, numbered from 0."""
    return ground_truth.select(F.posexplode("queries").alias("query_id", "q")).select("query_id", F.explode("q.relevant_docs").alias("doc_id"))
