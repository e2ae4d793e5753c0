"""Broadcasts behind a check of the size, the shared folder, and tables that cut lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only on a local master, as in tests, a temporary one stands in for it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewell-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A place in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder, in whatever store it lies."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)


def _width(df: DataFrame):
    """A column: about how many bytes a row takes."""
    total = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total += F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            total += 32 * F.greatest(F.size(F.col(field.name)), F.lit(0))
    return total


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` to broadcast if it was counted to have at most ``limit`` rows and bytes; else unchanged, and the join shuffles."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= most_bytes else df


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, known to have at most ``rows`` rows, to broadcast if that is within ``limit``; nothing is computed for it."""
    return F.broadcast(df) if rows <= limit else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder and read back; a lost executor can't lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (or ``path``) as compressed parquet and read back; ``remove`` deletes it."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
