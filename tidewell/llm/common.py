"""What several corpus operators share: the input table, stable row numbers, models in workers, broadcasts and tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans import sizes
from tidewell.plans.sizes import cut, new_path, remove, shared_folder, written

__all__ = ["batches_of", "cut", "documents", "free_name", "model", "modest_batches", "new_path", "numbered", "remove", "shared_folder", "small", "texts_of", "tokenizer_file", "written"]

#: Rows of two or three scalar columns that may be broadcast; above it a shuffled join is used.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1024
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to hold at most ``limit`` rows (and few bytes), else unchanged."""
    return sizes.small(df, limit)


def modest_batches(df: DataFrame, rows: int = BATCH_ROWS) -> None:
    """From now on the session's Arrow batches have at most so many rows: texts of a batch are held several times over, in the JVM and in Python."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= rows:
        conf.set(BATCH_SETTING, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed inside gets Arrow batches of at most so many rows."""
    usual = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, usual)


def texts_of(column: pa.Array, at_once: int = 64) -> Iterator[str | None]:
    """The texts of a batch, a few at a time as Python strings."""
    for k in range(0, len(column), at_once):
        yield from column.slice(k, at_once).to_pylist()


_held: dict = {}


def model(key, make: Callable):
    """What ``make`` gives, built once in each Python worker. Only the latest is held, as a worker serves one stage after another."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Forgets the worker's model and gives free memory back to the system."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't use (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: What a plan may consist of for its rows to be those of files, each once.
PLAIN = {"Project", "Filter", "LogicalRelation", "SubqueryAlias"}


def _plain(plan) -> bool:
    """Whether a JVM plan only selects from one scan of files."""
    while plan.getClass().getSimpleName() in PLAIN and plan.deterministic():
        children = plan.children()
        if children.size() == 0:
            return plan.getClass().getSimpleName() == "LogicalRelation"
        plan = children.apply(0)
    return False


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number of each row, which is the same whenever and wherever the table is scanned again.

    Rows of files are numbered by the file (in the order of paths) and their place in it, which the scan itself knows; Spark's own
    numbers depend on how files are dealt over tasks, which changes when executors come and go. Other tables are
    numbered once, in a copy in the shared folder.
    """
    place, path = free_name(docs, "place"), free_name(docs, "file")
    try:
        if "_metadata" in map(str.lower, docs.columns) or not _plain(docs._jdf.queryExecution().analyzed()):
            raise AttributeError
        scan = docs.select("*", F.col("_metadata.row_index").alias(place), F.col("_metadata.file_path").alias(path))
        # Spark's driver lists the files of a scan too.
        files = sorted(r[0] for r in scan.select(path).distinct().collect())
    except (AttributeError, AnalysisException):
        return written(docs.withColumn(row, F.monotonically_increasing_id()))
    if len(files) < 2:
        return scan.withColumn(row, F.col(place)).drop(place, path)
    first = free_name(docs, "first")
    order = docs.sparkSession.createDataFrame([(p, n << 40) for n, p in enumerate(files)], f"`{path}` string, `{first}` long")
    return scan.join(small(order), path).select(*docs.columns, (F.col(first) + F.col(place)).alias(row))


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
