"""Ranking: BM25, exact vector neighbours, reciprocal-rank fusion. Each takes a batch of queries.

Ties are broken by document id, after rounding scores to nine places, so results don't depend on the order in
which partial sums are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tidewell.functions.text import intent_weights, tokenize
from tidewell.operators.index import Index, idf
from tidewell.plans.sizes import bounded, small

K1, B = 1.2, 0.9
RRF_OFFSET, RRF_SCALE = 60, 100
MIN_COSINE = 0.55
#: How many times more candidates than results are fetched.
OVERFETCH = 5


def top(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query with their rank from 1; Spark limits each partition's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, qtf)``: a repeated term counts as often as it occurs."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_scores(queries: DataFrame, index: Index, k1: float | Column = K1, b: float | Column = B, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(query_id, doc_id, score)`` of all documents that have a term of the query.

    ``k1`` and ``b`` may be columns of ``queries`` named in ``keep`` (a parameter grid).
    """
    terms = query_terms(queries)
    # Everything keyed by query terms has as many rows as the queries have terms, at most.
    n_terms = terms.count()
    hits = index.postings.join(bounded(terms.select("term").distinct(), n_terms), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(bounded(df, n_terms), "term").crossJoin(F.broadcast(index.stats))
    if keep:
        weighted = weighted.join(bounded(queries.select("query_id", *keep), n_terms), "query_id")
    # A document without a known length counts as average.
    with_length = hits.join(index.doc_lengths, "doc_id", "left")
    joined = with_length.join(bounded(weighted, n_terms), "term")
    k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (k1, b))
    dl, tf = F.coalesce("dl", "avgdl"), F.col("tf")
    score = F.col("qtf") * idf(F.col("n_docs"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    return joined.groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))


def bm25(queries: DataFrame, index: Index, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    return top(bm25_scores(queries, index, k1, b), k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Query vectors multiplied at once, and those sent to the tasks for one scan of the vectors.
QUERY_BLOCK, QUERIES = 1024, 16_384


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, min_score: float | None = None) -> DataFrame:
    """The k vectors with the largest inner product with each query vector, then those of at least ``min_score``.

    queries: ``(query_id, vec)``, a stated set, of which ``QUERIES`` are gathered and sent to the tasks (as 32-bit numbers) for each scan,
    and multiplied in blocks of ``QUERY_BLOCK``; vectors: ``(doc_id, vec)``. Each batch of vectors keeps its own k best for each query, and only
    those are shuffled.
    """
    kind = vectors.schema["doc_id"].dataType.simpleString()
    query_kind = queries.schema["query_id"].dataType.simpleString()
    arrow_kind = to_arrow_type(queries.schema["query_id"].dataType)
    result: DataFrame | None = None
    block: list = []

    def scored(block: list) -> DataFrame:
        ids = [r["query_id"] for r in block]
        held = np.array([r["vec"] for r in block], np.float64)
        # Vectors are usually 32-bit numbers; then nothing is lost.
        held = held.astype(np.float32) if (held.astype(np.float32) == held).all() else held

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = batch.column(1)
                rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1).T
                n = min(k, batch.num_rows)
                for first in range(0, len(ids), QUERY_BLOCK):
                    scores = held[first: first + QUERY_BLOCK].astype(np.float64) @ rows
                    if n < batch.num_rows:
                        # All that tie with the last one stay, so ids can break the tie later.
                        least = -np.partition(-scores, n - 1, axis=1)[:, n - 1: n]
                        q, d = np.nonzero(scores >= least - 1e-9)
                    else:
                        q, d = (x.ravel() for x in np.indices(scores.shape))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[first + x] for x in q.tolist()], arrow_kind), batch.column(0).take(pa.array(d)), pa.array(scores[q, d])],
                                                     names=["query_id", "doc_id", "score"])

        return vectors.select("doc_id", "vec").where(F.col("vec").isNotNull()).mapInArrow(run, f"query_id {query_kind}, doc_id {kind}, score double")

    for row in queries.select("query_id", "vec").toLocalIterator():
        block.append(row)
        if len(block) == QUERIES:
            result = scored(block) if result is None else result.unionByName(scored(block))
            block = []
    if block or result is None:
        result = scored(block) if block else vectors.select(F.lit(None).cast(query_kind).alias("query_id"), "doc_id", F.lit(0.0).alias("score")).limit(0)
    best = top(result, k)
    return best if min_score is None else best.where(F.col("score") >= min_score)


def rrf(keyword: DataFrame, vector: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """Two ranked lists fused: each hit gives weight / (60 + rank from 0), times 100.

    weights: ``(query_id, bm25_weight, vector_weight)``, one row per query.
    """
    both = keyword.select("query_id", "doc_id", "rank", F.lit("k").alias("side")).unionByName(vector.select("query_id", "doc_id", "rank", F.lit("v").alias("side")))
    weight = F.when(F.col("side") == "k", F.col("bm25_weight")).otherwise(F.col("vector_weight"))
    fused = both.join(small(weights), "query_id").groupBy("query_id", "doc_id").agg((F.sum(weight / (RRF_OFFSET + F.col("rank") - 1)) * RRF_SCALE).alias("score"))
    return top(fused, k)


def hybrid(queries: DataFrame, index: Index, vectors: DataFrame, k: int = 10, min_score: float = MIN_COSINE, bm25_weight: float = 0.5, vector_weight: float = 0.5,
           k1: float = K1, b: float = B) -> DataFrame:
    """BM25 and vector search fused with weights by each query's intent. queries: ``(query_id, query, vec)``."""
    weights = queries.select("query_id", intent_weights(F.col("query"), bm25_weight, vector_weight).alias("w")).select("query_id", "w.*")
    keyword = bm25(queries, index, OVERFETCH * k, k1, b)
    vector = knn(queries.where(F.col("vec").isNotNull()), vectors, OVERFETCH * k)
    # Below the least cosine a hit is dropped, after the cut; ranks count what is left.
    vector = vector.where(F.col("score") >= min_score)
    return rrf(keyword, vector, weights, k)
