"""Named queries of data preparation: cleaning, normalising, deduplicating, counting, ingesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import dedup
from tidewell.plans.search_queries import table
from tidewell.plans.sizes import new_path
from tidewell.streaming import crawl_state, ingest

def title_clean_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.title_clean(F.col("text"))).alias("clean_md5"))


def clean_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html(F.col("html"), every_entity=False).alias("clean"))


def clean_html_unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every entity, through the Arrow UDF; the tables hold only common ones and cut-off ones, which stay, so the result is the same."""
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html(F.col("html")).alias("clean"))


def clean_price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("from "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" - 2.000.000 d"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.clean_price_text(shown).alias("price"))


def product_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.product_id(F.lower("p_type"), F.col("p_partkey").cast("string")).alias("id"))


KEYS = ["l_orderkey", "l_linenumber"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(*KEYS, "l_shipdate", "l_returnflag", (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("pos"), order.alias("src_ord"))


def dedup_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_latest(_lines(spark, sf_dir), KEYS, "l_shipdate", "pos").select(*KEYS, "l_shipdate", "pos")


def merge_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(_lines(spark, sf_dir), KEYS, "src_ord", "pos").select(*KEYS, "src_ord", "pos")


def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(_lines(spark, sf_dir), KEYS, "l_returnflag")


def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.count_by_source(table(spark, sf_dir, "documents"))


def anti_join_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return dedup.unseen(table(spark, sf_dir, "orders"), lines, "o_orderkey").select("o_orderkey", "o_custkey")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


def crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a crawl log: users as platforms, types as categories; a purchase completes its category."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("platform"), F.col("event_type").alias("category"),
                                                F.col("value").cast("int").alias("page"), (F.col("event_type") == "purchase").alias("done"))
    return crawl_state.stats(log, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the incremental stream over ``lineitem``'s order keys; the second finds nothing new."""
    to = new_path(spark, "stream")
    source = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    source.write.mode("overwrite").parquet(f"{to}/source")
    for _ in range(2):
        ingest.ingest(spark, f"{to}/source", f"{to}/out", f"{to}/state", source.schema, format="parquet").awaitTermination()
    return spark.read.parquet(f"{to}/out")


QUERIES = {f.__name__: f for f in (
    title_clean_docs, clean_html_pages, clean_html_unescaped, clean_price_text,
    product_ids, dedup_keep_latest, merge_keep_first, dedup_report, count_by_source, anti_join_unseen, json_fields, crawl_stats, stream_ingest)}

_CLEAN = "html"
for _entity, _plain in text.ENTITIES.items():
    _CLEAN = "replace({}, '{}', '{}')".format(_CLEAN, _entity, _plain.replace("'", "''"))
_CLEAN = rf"SELECT page_id, trim(regexp_replace(regexp_replace({_CLEAN}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM pages"
_LINES = """l AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_partkey * 1000000 + l_suppkey AS pos,
    CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS src_ord FROM lineitem)"""


ORACLE_SQL = {
    "title_clean_docs": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS clean_md5 FROM documents""",
    "clean_html_pages": _CLEAN,
    "clean_html_unescaped": _CLEAN,
    "clean_price_text": "SELECT o_orderkey, round(o_totalprice::DECIMAL(18,2) * 100)::BIGINT AS price FROM orders",
    "product_ids": "SELECT p_partkey, lower(p_type) || '_' || p_partkey AS id FROM part",
    "dedup_keep_latest": f"WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, pos) AS n FROM l) SELECT l_orderkey, l_linenumber, l_shipdate, pos FROM r WHERE n = 1",
    "merge_keep_first": f"WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY src_ord, pos) AS n FROM l) SELECT l_orderkey, l_linenumber, src_ord, pos FROM r WHERE n = 1",
    "dedup_report": f"""WITH {_LINES}, f AS (SELECT l_returnflag, count(*) AS before, count(DISTINCT (l_orderkey, l_linenumber)) AS after FROM l GROUP BY ALL),
        r AS (SELECT * FROM f UNION ALL SELECT NULL, sum(before)::BIGINT, sum(after)::BIGINT FROM f) SELECT *, before - after AS removed, round((before - after) * 100.0::DOUBLE / before, 2) AS percent FROM r""",
    "count_by_source": "SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY ALL",
    "anti_join_unseen": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "json_fields": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "crawl_stats": """WITH last AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 1)
        SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS total_crawled_products, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'purchase') AS completed_categories,
            CASE WHEN event_type <> 'purchase' THEN event_type END AS current_category, CASE WHEN event_type <> 'purchase' THEN trunc(value)::INT ELSE 0 END AS last_page FROM last""",
    "stream_ingest": "SELECT DISTINCT l_orderkey AS id FROM lineitem",
}
