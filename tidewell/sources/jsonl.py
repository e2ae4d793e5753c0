"""JSON-lines tables: strict and lenient scans, ordered files, appends without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans.sizes import cut

#: The canonical product record.
PRODUCT = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.StringType()), ("title", T.StringType()), ("price", T.LongType()), ("original_price", T.LongType()), ("sold_count", T.LongType()),
    ("platform", T.StringType()), ("category", T.StringType()), ("brand", T.StringType()), ("link", T.StringType()), ("image_url", T.StringType()),
    ("title_clean", T.StringType()), ("title_segmented", T.StringType()), ("source_file", T.StringType()))])


def read_strict(spark: SparkSession, path: str | list[str], schema: T.StructType = PRODUCT) -> DataFrame:
    """Fails on a malformed line; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, v, file)``: each line, its variant (null if malformed or blank), and the file's name."""
    lines = spark.read.text(path)
    return lines.select("value", F.try_parse_json("value").alias("v"), F.col("_metadata.file_name").alias("file"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern has files, in whatever store it names."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path)
    return found is not None and len(found) > 0


def read_ordered(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """The files one after the other (``src_ord``, ``pos``: place in a file), and those that are missing."""
    found, missing = None, []
    for order, path in enumerate(paths):
        if not exists(spark, path):
            missing.append(path)
            continue
        own = read_lenient(spark, path).withColumns({"src_ord": F.lit(order), "pos": F.monotonically_increasing_id()})
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
    return found, missing


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All JSON-lines files of a folder, by file name."""
    return read_lenient(spark, f"{folder}/*.jsonl")


def seen_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of a table that may not exist yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id string")
    return spark.read.schema("id string").json(path).where("id IS NOT NULL").distinct()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_unseen(df: DataFrame, path: str) -> None:
    """Appends one row of each id that the table lacks; rows without an id are skipped."""
    # The ids are cut off from the files that the write adds to.
    fresh = df.where("id IS NOT NULL").join(cut(seen_ids(df.sparkSession, path)), "id", "left_anti").dropDuplicates(["id"])
    append(fresh, path)


def counts(lines: DataFrame) -> DataFrame:
    """``(source, n)`` of valid lines, and in the row with a null source all lines, malformed ones too."""
    source = F.when(F.col("v").isNull(), F.lit("")).otherwise(F.coalesce(F.try_variant_get("v", "$.source", "string"), F.lit("unknown")))
    each = lines.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(None).cast("string").alias("source"), "n")
    return each.where("source <> ''").unionByName(total)


GROUND_TRUTH = "description string, version string, queries array<struct<query: string, category: string, relevant_docs: array<string>, notes: string>>"


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path)
