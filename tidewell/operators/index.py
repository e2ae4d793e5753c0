"""The inverted index as tables: postings, document lengths, corpus and term statistics.

``postings(term, doc_id, tf)`` stays in long form, so a frequent term is spread over tasks; nested lists are made
for export and compression only. Ids are unique (``build`` can check it).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.codec import vb_decoded, vb_encoded
from tidewell.functions.text import tokenize
from tidewell.plans.sizes import cut


@dataclass
class Index:
    postings: DataFrame
    doc_lengths: DataFrame
    stats: DataFrame


def tokens(docs: DataFrame, text: Column, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, tokens)`` of documents that have any."""
    return docs.select(F.col(id_col).alias("doc_id"), tokenize(text).alias("tokens")).where(F.size("tokens") > 0)


def postings(tokened: DataFrame) -> DataFrame:
    return tokened.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(tokened: DataFrame) -> DataFrame:
    return tokened.select("doc_id", F.size("tokens").cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    """Always positive; 0 for a term that no document has."""
    return F.when(df > 0, F.log((n_docs - df + 0.5) / (df + 0.5) + 1)).otherwise(0.0)


def term_stats(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """``(term, df, idf)``."""
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))


#: Documents of a block. A term's postings are put together by blocks, so no task gathers all of a frequent term's.
BLOCK = 65_536


def blocked(posted: DataFrame, ids: DataFrame, size: int = BLOCK) -> DataFrame:
    """Postings with the documents' numbers and blocks: ``(term, block, int_id, doc_id, tf)``."""
    return posted.join(ids, "doc_id").select("term", F.floor((F.col("int_id") - 1) / size).alias("block"), "int_id", "doc_id", "tf")


def posting_lists(posted: DataFrame, ids: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(term, block, df, postings)``: each term's postings in a block of documents, by document. ids: as ``doc_id_map`` gives."""
    entry = F.struct("int_id", "doc_id", "tf")
    lists = blocked(posted, ids, size).groupBy("term", "block").agg(F.count(F.lit(1)).alias("df"), F.sort_array(F.collect_list(entry)).alias("postings"))
    return lists.withColumn("postings", F.transform("postings", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["tf"].alias("tf"))))


def build(docs: DataFrame, text: Column, id_col: str = "doc_id", check_ids: bool = False) -> Index:
    tokened = tokens(docs, text, id_col)
    if check_ids and not tokened.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("document ids repeat")
    lengths = doc_lengths(tokened)
    return Index(postings(tokened), lengths, corpus_stats(lengths))


def save(index: Index, path: str, partitions: int | None = None) -> None:
    """Parquet tables; postings are range-partitioned and sorted by term, so a lookup reads few row groups."""
    by_term = index.postings.repartitionByRange(*([partitions] if partitions else []), "term").sortWithinPartitions("term", "doc_id")
    by_term.write.mode("overwrite").parquet(f"{path}/postings")
    index.doc_lengths.write.mode("overwrite").parquet(f"{path}/doc_lengths")
    lengths = index.doc_lengths.sparkSession.read.parquet(f"{path}/doc_lengths")
    corpus_stats(lengths).write.mode("overwrite").parquet(f"{path}/stats")


def save_compressed(index: Index, path: str) -> None:
    compressed, ids = compress(index.postings)
    ids.write.mode("overwrite").parquet(f"{path}/doc_id_map")
    compressed.write.mode("overwrite").parquet(f"{path}/postings_vb")


def load(spark: SparkSession, path: str) -> Index:
    """The saved index; its compressed postings are preferred if both their tables exist."""
    def table(name: str) -> DataFrame | None:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
        return spark.read.parquet(f"{path}/{name}") if there else None

    vb, ids = table("postings_vb"), table("doc_id_map")
    posted = decompress(vb, ids) if vb is not None and ids is not None else table("postings")
    lengths, stats = table("doc_lengths"), table("stats")
    if posted is None or lengths is None or stats is None:
        raise FileNotFoundError(f"no index at {path}")
    return Index(posted, lengths, stats)


def doc_id_map(posted: DataFrame) -> DataFrame:
    """``(doc_id, int_id)``: dense numbers from 1 in the order of ids.

    Ids are sorted over ranges and numbered within each; the ranges' sizes, one row each, give where they begin.
    """
    ids = posted.select("doc_id").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    part = ids.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    # Written once, so the numbers can't change when a task is run again.
    part = cut(part)
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return part.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("place") + 1).alias("int_id"))


def posting_gaps(posted: DataFrame, ids: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(term, int_id, gap, tf)``: the distance to the term's document before. A block's first goes on from the last of the blocks before."""
    numbered = blocked(posted, ids, size)
    within = F.lag("int_id").over(Window.partitionBy("term", "block").orderBy("int_id"))
    ends = numbered.groupBy("term", "block").agg(F.max("int_id").alias("end"))
    before = ends.select("term", "block", F.lag("end", 1, 0).over(Window.partitionBy("term").orderBy("block")).alias("before"))
    gap = F.col("int_id") - F.coalesce("within", "before")
    return numbered.withColumn("within", within).join(before, ["term", "block"]).select("term", "int_id", gap.alias("gap"), "tf")


def compress(posted: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(term, block, data)`` of gaps and frequencies in variable-byte code, and the document numbers. A block's gaps begin at 0, so it stands for itself."""
    posted = cut(posted)
    ids = doc_id_map(posted)
    lists = blocked(posted, ids, size).groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("int_id", "tf"))).alias("p"))

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            sizes, entries = np.diff(column.offsets.to_numpy()), column.flatten()
            number = entries.field("int_id").to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            pairs = np.empty(2 * len(number), np.int64)
            pairs[::2] = np.diff(number, prepend=0)
            pairs[2 * starts] = number[starts]
            pairs[1::2] = entries.field("tf").to_numpy(zero_copy_only=False)
            data, widths = vb_encoded(pairs)
            ends = np.concatenate(([0], np.cumsum(widths)))[np.concatenate((2 * starts, [len(pairs)]))]
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], names=["term", "block", "data"])

    return lists.mapInArrow(run, "term string, block long, data binary"), ids


def decompress(compressed: DataFrame, ids: DataFrame) -> DataFrame:
    """The postings again; a number that the map lacks becomes its own text."""
    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            values, last = vb_decoded(np.frombuffer(b"".join(rows), np.uint8))
            gaps, tf = values[::2], values[1::2]
            # Rows hold whole pairs; where each one's begin.
            counts = np.diff(np.searchsorted(last, np.concatenate(([0], np.cumsum(lengths))))) // 2
            sums = np.concatenate(([0], np.cumsum(gaps)))
            number = sums[1:] - np.repeat(sums[np.cumsum(counts) - counts], counts)
            term = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), counts)))
            yield pa.RecordBatch.from_arrays([term, pa.array(number, pa.int64()), pa.array(tf, pa.int64())], names=["term", "int_id", "tf"])

    flat = compressed.select("term", "data").mapInArrow(run, "term string, int_id long, tf long")
    kind = ids.schema["doc_id"].dataType
    return flat.join(ids, "int_id", "left").select("term", F.coalesce("doc_id", F.col("int_id").cast("string").try_cast(kind)).alias("doc_id"), "tf")
