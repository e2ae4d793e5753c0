"""Named queries of the index, the rankers, the search engine and the evaluation, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import codec
from tidewell.functions.text import format_price, intent_weights, tokenize
from tidewell.operators import evaluate, index, ranking, search, vectors
from tidewell.plans.sizes import cut, new_path

#: The stated batch of queries.
BATCH = [(1, "the with"), (2, "la de les"), (3, "und der schen"), (4, "Apache License, Version"), (5, "the the of"), (6, "xyznonexist"), (7, "que ción para"), (8, "worthless scum")]
#: Offer searches over ``part``.
OFFERS = [(1, "red widget"), (2, "small ring gear"), (3, "hot bolt")]
#: Places of the reports: enough that means of eight rounded values aren't cut at a tie.
DIGITS = 8
GRID = [(1.2, 0.9), (1.2, 0.75), (1.5, 0.75), (2.0, 0.5)]
#: Every hundredth vector is a query.
EVERY = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(rows or BATCH, "query_id int, query string")


def spread(scan: DataFrame) -> DataFrame:
    """A scan in fewer partitions than there are cores (few row groups) dealt over the cores; a larger one as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def document_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return index.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), F.col("text"))


def shown(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", F.round("score", 6))


def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).postings


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).doc_lengths


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).stats.withColumn("avgdl", F.round("avgdl", 6))


def term_stats_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = document_index(spark, sf_dir)
    return index.term_stats(own.postings, own.stats).withColumn("idf", F.round("idf", 6))


#: Documents of a block in the queries, so that small tables have several.
SMALL_BLOCK = 256


def postings_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(document_index(spark, sf_dir).postings)
    lists = index.posting_lists(own, index.doc_id_map(own), SMALL_BLOCK)
    return lists.select("term", "block", "df", F.md5(F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["tf"])), ",")).alias("postings_md5"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ranking.bm25(batch(spark, [(1, "that license from")]), document_index(spark, sf_dir), 10))


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ranking.bm25(batch(spark), document_index(spark, sf_dir), 10))


def bm25_repeated_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ranking.bm25(batch(spark, [(1, "with"), (2, "with with")]), document_index(spark, sf_dir), 10))


def bm25_tune_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parameter pairs and queries in one job; the first six of each."""
    rows = [(100 * n + q, text, k1, b) for n, (k1, b) in enumerate(GRID) for q, text in BATCH[:3]]
    grid = spark.createDataFrame(rows, "query_id int, query string, k1 double, b double")
    scored = ranking.bm25_scores(grid, document_index(spark, sf_dir), F.col("k1"), F.col("b"), keep=("k1", "b"))
    return shown(ranking.top(scored, 6))


def intent_weights_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", intent_weights(F.col("text")).alias("w")).select("conv_id", "turn", "w.*")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def _vector_queries(own: DataFrame) -> DataFrame:
    return own.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), "vec")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vectors(spark, sf_dir)
    return shown(ranking.knn(_vector_queries(own), own, 10))


def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vectors(spark, sf_dir)
    return shown(ranking.knn(_vector_queries(own), own, 10, ranking.MIN_COSINE))


def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.check(_vectors(spark, sf_dir))


def _hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vectors(spark, sf_dir).select((F.col("doc_id") / 7).cast("int").alias("query_id"), "vec", F.col("doc_id").alias("_v")).where("_v % 7 = 0 AND query_id <= 8")
    return batch(spark).join(own.drop("_v"), "query_id")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ranking.hybrid(_hybrid_queries(spark, sf_dir), document_index(spark, sf_dir), _vectors(spark, sf_dir), 10, min_score=0.2))


def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("n_chars").alias("price"), F.col("source").alias("platform"),
        F.col("lang").alias("category"), F.concat(F.lit("doc/"), "doc_id").alias("link"), F.lit(None).cast("string").alias("image_url"))


def search_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = search.SearchEngine(document_index(spark, sf_dir), search.doc_store(document_store(spark, sf_dir)))
    return engine.search(batch(spark), 10)


def doc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.doc_store(document_store(spark, sf_dir))


def _ranked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each query with their source, ranked by the rounded score."""
    engine = search.SearchEngine(document_index(spark, sf_dir), search.doc_store(document_store(spark, sf_dir)))
    return engine.search(batch(spark), 50).select("query_id", "doc_id", "platform", "score", "rank")


def diversify_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.diversify(_ranked_sources(spark, sf_dir), 10, 3).select("query_id", "doc_id", "platform", "rank")


def _offer_engine(spark: SparkSession, sf_dir: str) -> search.SearchEngine:
    parts = table(spark, sf_dir, "part")
    products = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").cast("bigint").alias("price"), F.col("p_type").alias("platform"),
                            F.col("p_brand").alias("category"), F.lit("").alias("link"), F.lit("").alias("image_url"))
    return search.SearchEngine(index.build(parts, F.col("p_name"), "p_partkey"), search.doc_store(products))


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offer_engine(spark, sf_dir).search(batch(spark, OFFERS), 50)


def filter_price_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filter_offers(_offers(spark, sf_dir), ["SMALL", "PROMO", "LARGE"], 901, 1000).select("query_id", "doc_id", "platform", "price", "rank")


def sort_price_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.page(_offers(spark, sf_dir), search.sort_offers(None, "price_desc"), 2)
    return found.select("query_id", "doc_id", "price", F.col("position").cast("long"), "pages")


def format_price_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 1000).cast("bigint").alias("p"))
    return dear.select("o_orderkey", format_price(F.col("p")).alias("shown"), format_price(F.col("p") - F.col("p"), "Lien he", " d").alias("zero"))


def posting_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(document_index(spark, sf_dir).postings)
    return index.posting_gaps(own, index.doc_id_map(own), SMALL_BLOCK)


def compress_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.decompress(*index.compress(document_index(spark, sf_dir).postings))


_saved: dict[tuple[str, str], str] = {}


def saved_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the documents' saved index, both plain and compressed; made once in an application, as a search service does."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _saved:
        path = new_path(spark, "index")
        own = document_index(spark, sf_dir)
        own = index.Index(cut(own.postings), cut(own.doc_lengths), own.stats)
        index.save(own, f"{path}/plain")
        index.save(own, f"{path}/compressed")
        index.save_compressed(own, f"{path}/compressed")
        _saved[key] = path
    return _saved[key]


def index_saved_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.load(spark, f"{saved_index(spark, sf_dir)}/plain").postings


def compressed_index_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of an index whose compressed tables are there, which are preferred."""
    return index.load(spark, f"{saved_index(spark, sf_dir)}/compressed").postings


def bm25_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ranking.bm25(batch(spark), index.load(spark, f"{saved_index(spark, sf_dir)}/plain"), 10))


def hybrid_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ranking.hybrid(_hybrid_queries(spark, sf_dir), index.load(spark, f"{saved_index(spark, sf_dir)}/plain"), _vectors(spark, sf_dir), 10, min_score=0.2))


def search_mode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mode that needs vectors, set on an engine without them: the results are BM25's."""
    engine = search.SearchEngine(index.load(spark, f"{saved_index(spark, sf_dir)}/plain"), search.doc_store(document_store(spark, sf_dir)))
    engine.set_mode("hybrid")
    return engine.search(batch(spark), 10)


def console_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query as a console shows it: the ten best, with formatted prices."""
    engine = search.SearchEngine(index.load(spark, f"{saved_index(spark, sf_dir)}/plain"), search.doc_store(document_store(spark, sf_dir)))
    return engine.search_one(spark, "la de les").select("rank", "doc_id", "title", "score", format_price(F.col("price"), "Lien he", " d").alias("shown"))


def offers_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, sorted and paged offers as an interactive list shows them."""
    found = _offer_engine(spark, sf_dir).offers(batch(spark, OFFERS), ["SMALL", "PROMO", "LARGE"], 901, 1000, "price_asc", 1)
    return found.select("query_id", "doc_id", "price", F.col("position").cast("long"), "pages")


def gamma_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", codec.gamma_encode(F.col("event_id") + 1).alias("bits"))


def vb_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JVM form and the byte form of the code, and what the latter decodes to."""
    n = F.col("o_orderkey") * 97
    data = codec.vb_encode(n)
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.vb_hex(n).alias("code"), F.hex(data).alias("bytes_code"), F.get(codec.vb_decode(data), F.lit(0)).alias("decoded"))


def _measured(spark: SparkSession, sf_dir: str, k1: float = ranking.K1, b: float = ranking.B) -> DataFrame:
    hits = ranking.bm25(batch(spark), document_index(spark, sf_dir), 20, k1, b)
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return evaluate.metrics(batch(spark), hits, good, 10)


def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("query_id", *(F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")))


def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_measured(spark, sf_dir), DIGITS)


def eval_compare_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare(evaluate.summary(_measured(spark, sf_dir), DIGITS), evaluate.summary(_measured(spark, sf_dir, 2.0, 0.1), DIGITS), DIGITS)


def build_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluate.pseudo_ground_truth(batch(spark), ranking.bm25(batch(spark), document_index(spark, sf_dir), 20))
    return made.select("query_id", F.size("all_results").cast("long").alias("n_results"), F.array_join("relevant_docs", ",").alias("relevant"))


QUERIES = {f.__name__: f for f in (
    tokenize_docs, term_frequency, doc_lengths, corpus_stats, term_stats_idf, postings_lists, bm25_topk, bm25_batch, bm25_repeated_term, bm25_tune_grid,
    intent_weights_turns, knn_topk, knn_threshold, vector_check, hybrid_rrf, search_enriched, doc_store, diversify_platforms, filter_price_platform, sort_price_page, format_price_parts,
    posting_gaps, compress_roundtrip, index_saved_postings, compressed_index_load, bm25_saved_index, hybrid_saved_index, search_mode_fallback, console_search, offers_page, gamma_encode, vb_encode, precision_recall_f1, ndcg, mrr, eval_report, eval_compare_modes, build_ground_truth)}

# --- oracles ---

TOKENS = r"""tok AS (SELECT doc_id, t AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS t FROM documents) WHERE length(t) > 1),
    tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY ALL),
    stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl)"""


def _values(rows: list) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def _scores(rows: list, tokens: str = TOKENS, more: str = "", k1: str = "1.2::DOUBLE", b: str = "0.9::DOUBLE") -> str:
    """CTEs up to ``ranked(query_id, doc_id, score, rank)``."""
    return rf"""{tokens}, q AS (SELECT * FROM (VALUES {_values(rows)}) v(query_id, query{more})),
    qt AS (SELECT query_id, t AS term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query), '\s+')) AS t FROM q) WHERE length(t) > 1 GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, sum(qtf * ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
        FROM qt JOIN q USING (query_id) JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), stats GROUP BY ALL),
    ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)"""


SHOWN = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= "

KNN = """WITH v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vec FROM embeddings),
    scored AS (SELECT q.doc_id AS query_id, v.doc_id, list_dot_product(q.vec, v.vec) AS score FROM v q, v WHERE q.doc_id % 100 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"""

#: The enriched list of each query: ``again(query_id, doc_id, ..., rank)`` of ``k`` results.
JUNK = r"regexp_full_match(lower(trim(title, e' \t\n\r')), '[0-9.,%\s-]+(đ|vnd)?')"


def _enriched(rows: list, store: str, k: int, tokens: str = TOKENS) -> str:
    return rf"""{_scores(rows, tokens)}, store AS ({store}),
    again AS (SELECT query_id, doc_id, title, price, platform, category, link, image_url, round(score, 4) AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, rank) AS rank
        FROM ranked JOIN store USING (doc_id) WHERE rank <= 5 * {k} AND NOT {JUNK})"""


#: The batch as query expansion leaves it.
EXPANDED = [(q, text.lower().replace(",", "")) for q, text in BATCH]
STORE = r"SELECT doc_id, string_split(text, chr(10))[1] AS title, source AS platform, lang AS category, 'doc/' || doc_id AS link, '' AS image_url, n_chars AS price FROM documents"
PART_TOKENS = r"""tok AS (SELECT p_partkey AS doc_id, unnest(regexp_split_to_array(lower(p_name), '\s+')) AS term FROM part),
    tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY ALL),
    stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl)"""
PART_STORE = "SELECT p_partkey AS doc_id, p_name AS title, trunc(p_retailprice)::BIGINT AS price, p_type AS platform, p_brand AS category, '' AS link, '' AS image_url FROM part"
OFFER_CTES = _enriched(OFFERS, PART_STORE, 50, PART_TOKENS)


def _measures(name: str, k1: str = "1.2::DOUBLE", b: str = "0.9::DOUBLE") -> str:
    """CTE text of per-query measures over the first 20 results, after the tokens' CTEs."""
    scores = _scores(BATCH, TOKENS, k1=k1, b=b)
    return f"""{name} AS (WITH {scores},
    rel AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), n AS (SELECT count(*) AS n_rel FROM rel),
    per AS (SELECT query_id, count(*) FILTER (rank <= 10 AND rel.doc_id IS NOT NULL) AS hits, count(*) FILTER (rank <= 5 AND rel.doc_id IS NOT NULL) AS short_hits, sum(1 / log2(rank + 1)) FILTER (rank <= 10 AND rel.doc_id IS NOT NULL) AS dcg,
        min(rank) FILTER (rel.doc_id IS NOT NULL) AS first_hit FROM (SELECT * FROM ranked WHERE rank <= 20) LEFT JOIN rel USING (doc_id) GROUP BY query_id),
    full_ AS (SELECT q.query_id, coalesce(hits, 0) AS hits, coalesce(short_hits, 0) AS short_hits, coalesce(dcg, 0) AS dcg, first_hit, n_rel FROM q LEFT JOIN per USING (query_id), n)
    SELECT query_id, hits / 10 AS precision, short_hits / 5 AS precision_short, hits / n_rel AS recall, CASE WHEN hits > 0 THEN 2 * (hits / 10) * (hits / n_rel) / (hits / 10 + hits / n_rel) ELSE 0 END AS f1,
        dcg / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, coalesce(1 / first_hit, 0) AS rr FROM full_)"""


def _means(of: str) -> str:
    names = evaluate.MEASURES
    return "count(*) AS n_queries, " + ", ".join(f"round(avg(round({n}, 4)), {DIGITS}) AS avg_{n}" for n in names) + f", round(avg(rr), {DIGITS}) AS mrr FROM {of}"


_LONG = " UNION ALL ".join(f"SELECT '{n}' AS measure, a.{n} AS first, b.{n} AS second FROM a, b" for n in (*(f"avg_{m}" for m in evaluate.MEASURES), "mrr"))
_GRID_ROWS = [(100 * n + q, text, k1, b) for n, (k1, b) in enumerate(GRID) for q, text in BATCH[:3]]
_TECH = r"'\d+[a-z]*|[a-z]+\d+|pro|max|ultra|plus|mini|gb|tb|mah'"
_WEIGHT = ("CASE WHEN n = 0 THEN 0.5 WHEN t / n >= 0.5 THEN {} WHEN n >= 5 AND t / n <= 0.2 THEN {} WHEN t > 0 THEN {} ELSE 0.5 END::DOUBLE")

ORACLE_SQL = {
    "tokenize_docs": r"""SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 1) AS t FROM documents)""",
    "term_frequency": f"WITH {TOKENS} SELECT term, doc_id, tf FROM tf",
    "doc_lengths": f"WITH {TOKENS} SELECT doc_id, dl FROM dl",
    "corpus_stats": f"WITH {TOKENS} SELECT n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "term_stats_idf": f"WITH {TOKENS} SELECT term, count(*) AS df, round(ln((any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 6) AS idf FROM tf, stats GROUP BY term",
    "postings_lists": f"""WITH {TOKENS}, ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS int_id FROM dl)
        SELECT term, (int_id - 1) // {SMALL_BLOCK} AS block, count(*) AS df, md5(string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id)) AS postings_md5 FROM tf JOIN ids USING (doc_id) GROUP BY ALL""",
    "bm25_topk": f"WITH {_scores([(1, 'that license from')])} {SHOWN} 10",
    "bm25_batch": f"WITH {_scores(BATCH)} {SHOWN} 10",
    "bm25_repeated_term": f"WITH {_scores([(1, 'with'), (2, 'with with')])} {SHOWN} 10",
    "bm25_tune_grid": f"WITH {_scores(_GRID_ROWS, more=', k1, b', k1='k1', b='b')} {SHOWN} 6",
    "intent_weights_turns": rf"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM conversations),
        c AS (SELECT conv_id, turn, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, {_TECH}))) AS t FROM w)
        SELECT conv_id, turn, {_WEIGHT.format('0.8', '0.2', '0.6')} AS bm25_weight, {_WEIGHT.format('0.2', '0.8', '0.4')} AS vector_weight FROM c""",
    "vector_check": "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, min(len(embedding)) AS least_dimensions, max(len(embedding)) AS most_dimensions, sum(len(embedding))::BIGINT * 4 AS n_bytes FROM embeddings",
    "knn_topk": KNN,
    "knn_threshold": KNN + " AND score >= 0.55",
    "hybrid_rrf": rf"""WITH {_scores(BATCH)}, hv AS (SELECT vec_id // 7 AS query_id, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 7 = 0 AND vec_id // 7 <= 8),
        hq AS (SELECT query_id, query, vec FROM q JOIN hv USING (query_id)),
        vs AS (SELECT query_id, vec_id AS doc_id, list_dot_product(hq.vec, embedding::DOUBLE[]) AS score FROM hq, embeddings),
        vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vs),
        w AS (SELECT query_id, len(x) AS n, len(list_filter(x, lambda y: regexp_matches(y, {_TECH}))) AS t FROM (SELECT query_id, regexp_split_to_array(lower(query), '\s+') AS x FROM hq)),
        ww AS (SELECT query_id, {_WEIGHT.format('0.8', '0.2', '0.6')} AS bw, {_WEIGHT.format('0.2', '0.8', '0.4')} AS vw FROM w),
        parts AS (SELECT query_id, doc_id, bw / (60 + rank - 1) AS s FROM ranked JOIN ww USING (query_id) WHERE rank <= 50
            UNION ALL SELECT query_id, doc_id, vw / (60 + rank - 1) AS s FROM vr JOIN ww USING (query_id) WHERE rank <= 50 AND score >= 0.2),
        fused AS (SELECT query_id, doc_id, sum(s) * 100 AS score FROM parts GROUP BY ALL),
        top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused)
        SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top WHERE rank <= 10""",
    "index_saved_postings": f"WITH {TOKENS} SELECT term, doc_id, tf FROM tf",
    "compressed_index_load": f"WITH {TOKENS} SELECT term, doc_id, tf FROM tf",
    "bm25_saved_index": f"WITH {_scores(BATCH)} {SHOWN} 10",
    "search_mode_fallback": f"WITH {_enriched(EXPANDED, STORE, 10)} SELECT * FROM again WHERE rank <= 10",
    "console_search": f"""WITH {_enriched([(0, 'la de les')], STORE, 10)} SELECT rank, doc_id, title, score, CASE WHEN price = 0 THEN 'Lien he' ELSE replace(format('{{:,}}', price), ',', '.') || ' d' END AS shown
        FROM again WHERE rank <= 10""",
    "offers_page": f"""WITH {OFFER_CTES}, f AS (SELECT * FROM again WHERE rank <= 50 AND platform IN ('SMALL', 'PROMO', 'LARGE') AND (price BETWEEN 901 AND 1000 OR price = 0)),
        s AS (SELECT query_id, doc_id, price, row_number() OVER (PARTITION BY query_id ORDER BY price, rank) AS position, ceil(count(*) OVER (PARTITION BY query_id) / 12)::BIGINT AS pages FROM f)
        SELECT * FROM s WHERE position <= 12""",
    "search_enriched": f"WITH {_enriched(EXPANDED, STORE, 10)} SELECT * FROM again WHERE rank <= 10",
    "doc_store": STORE,
    "diversify_platforms": f"""WITH {_enriched(EXPANDED, STORE, 50)}, r AS (SELECT * FROM again WHERE rank <= 50),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id, platform ORDER BY rank) AS place, min(rank) OVER (PARTITION BY query_id, platform) AS first,
            count(*) OVER (PARTITION BY query_id) AS n FROM r),
        o AS (SELECT *, min(first) OVER (PARTITION BY query_id) = max(first) OVER (PARTITION BY query_id) AS alone FROM p),
        d AS (SELECT query_id, doc_id, platform, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 10 OR alone THEN 0 ELSE place END, CASE WHEN n <= 10 OR alone THEN rank ELSE first END) AS rank
            FROM o WHERE n <= 10 OR alone OR place <= 27)
        SELECT * FROM d WHERE rank <= 10""",
    "filter_price_platform": f"""WITH {OFFER_CTES} SELECT query_id, doc_id, platform, price, rank FROM again
        WHERE rank <= 50 AND platform IN ('SMALL', 'PROMO', 'LARGE') AND (price BETWEEN 901 AND 1000 OR price = 0)""",
    "sort_price_page": f"""WITH {OFFER_CTES}, s AS (SELECT query_id, doc_id, price, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, rank) AS position,
            ceil(count(*) OVER (PARTITION BY query_id) / 12)::BIGINT AS pages FROM again WHERE rank <= 50) SELECT * FROM s WHERE position BETWEEN 13 AND 24""",
    "format_price_parts": """SELECT o_orderkey, CASE WHEN p = 0 THEN 'Liên hệ' ELSE replace(format('{:,}', p), ',', '.') || '₫' END AS shown, 'Lien he' AS zero
        FROM (SELECT o_orderkey, trunc(o_totalprice * 1000)::BIGINT AS p FROM orders)""",
    "posting_gaps": f"""WITH {TOKENS}, ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS int_id FROM dl)
        SELECT term, int_id, int_id - lag(int_id, 1, 0) OVER (PARTITION BY term ORDER BY int_id) AS gap, tf FROM tf JOIN ids USING (doc_id)""",
    "compress_roundtrip": f"WITH {TOKENS} SELECT term, doc_id, tf FROM tf",
    "gamma_encode": "SELECT event_id, repeat('1', length(b) - 1) || '0' || substr(b, 2) AS bits FROM (SELECT event_id, bin(event_id + 1) AS b FROM events)",
    "vb_encode": """WITH n AS (SELECT o_orderkey, o_orderkey * 97 AS n, greatest(1, ceil(length(bin(o_orderkey * 97)) / 7))::INT AS g FROM orders),
        c AS (SELECT o_orderkey, n, array_to_string(list_transform(range(0, g), lambda i: printf('%02X', ((n >> (7 * (g - 1 - i))::INT) & 127) + CASE WHEN i = g - 1 THEN 128 ELSE 0 END)), '') AS code FROM n)
        SELECT o_orderkey, code, code AS bytes_code, n AS decoded FROM c""",
    "precision_recall_f1": f"WITH {_measures('m')} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m",
    "ndcg": f"WITH {_measures('m')} SELECT query_id, round(ndcg, 6) AS ndcg FROM m",
    "mrr": f"WITH {_measures('m')} SELECT round(avg(rr), 6) AS mrr FROM m",
    "eval_report": f"WITH {_measures('m')} SELECT {_means('m')}",
    "eval_compare_modes": f"""WITH {_measures('ma')}, {_measures('mb', '2.0::DOUBLE', '0.1::DOUBLE')}, a AS (SELECT {_means('ma')}), b AS (SELECT {_means('mb')}), l AS ({_LONG})
        SELECT measure, first, second, round(second - first, {DIGITS}) AS difference, CASE WHEN round(second - first, {DIGITS}) > 0 THEN 'up' WHEN round(second - first, {DIGITS}) < 0 THEN 'down' ELSE 'same' END AS trend FROM l""",
    "build_ground_truth": f"""WITH {_scores(BATCH)} SELECT query_id, count(rank) AS n_results, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 5), '') AS relevant
        FROM q LEFT JOIN (SELECT * FROM ranked WHERE rank <= 20) USING (query_id) GROUP BY query_id""",
}

ORACLE_SQL["hybrid_saved_index"] = ORACLE_SQL["hybrid_rrf"]
