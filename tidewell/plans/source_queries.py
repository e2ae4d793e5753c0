"""Named queries of the sources and parsers: files are made of the driver's tables, written to the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import codec, text
from tidewell.operators import evaluate, vectors
from tidewell.plans.search_queries import table
from tidewell.plans.sizes import new_path
from tidewell.sources import jsonl, products
from tidewell.streaming import crawl_state


def _folder(spark: SparkSession) -> str:
    return new_path(spark, "lines")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.text(path)


def _record(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def _price() -> Column:
    return F.col("p_retailprice").cast("bigint")


def scan_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    _lines(_parts(spark, sf_dir), _record(id=F.col("p_partkey").cast("string"), title=F.col("p_name"), price=_price()), path)
    return jsonl.read_strict(spark, path).select("id", "title", "price")


def scan_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line is malformed, every eleventh blank."""
    path, key = _folder(spark), F.col("p_partkey")
    good = _record(id=key.cast("string"), title=F.col("p_name"))
    _lines(_parts(spark, sf_dir), F.when(key % 7 == 0, F.concat(F.lit("not json "), key.cast("string"))).when(key % 11 == 0, "").otherwise(good), path)
    return jsonl.read_lenient(spark, path).where("v IS NOT NULL").select(F.try_variant_get("v", "$.id", "bigint").alias("id"), F.try_variant_get("v", "$.title", "string").alias("title"))


def scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files and a missing one between them; of the rows of an id the first file's stays."""
    root, key = _folder(spark), F.col("p_partkey")
    parts = _parts(spark, sf_dir)
    _lines(parts.where(key % 2 == 0), _record(id=key.cast("string"), title=F.concat(F.lit("first "), F.col("p_name")), price=_price()), f"{root}/a")
    _lines(parts.where(key % 3 == 0), _record(id=key.cast("string"), title=F.concat(F.lit("second "), F.col("p_name")), price=_price()), f"{root}/b")
    lines, missing = jsonl.read_ordered(spark, [f"{root}/a", f"{root}/none", f"{root}/b"])
    kept, _ = products.merge(lines)
    return kept.select("id", "title", "price", F.lit(len(missing)).alias("n_missing"))


def scan_folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all files of a folder by source, and in total with malformed ones."""
    root, key = _folder(spark), F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    for n in range(2):
        line = F.when(key % 5 == 0, "{broken").when(key % 5 == 1, _record(id=key)).otherwise(_record(id=key, source=F.col("source")))
        _lines(docs.where(key % 2 == n), line, f"{root}/{n}.jsonl")
    return jsonl.counts(jsonl.read_folder(spark, root))


def append_unseen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends of unseen customers, the second with all that the first had, and an unconditional one."""
    path = _folder(spark)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_custkey")
    jsonl.append_unseen(orders.where("o_custkey % 2 = 0").select("id"), path)
    jsonl.append_unseen(orders.select("id"), path)
    jsonl.append(orders.where("o_custkey % 5 = 0").select("id").distinct(), path)
    found = spark.read.schema("id string").json(path).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(jsonl.seen_ids(spark, path), "id")


def ground_truth_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ground-truth document of two queries, whose relevant documents come from the labels."""
    path = _folder(spark)
    labels = table(spark, sf_dir, "labels")
    queries = labels.groupBy("quality").agg(F.sort_array(F.collect_list(F.col("doc_id").cast("string"))).alias("relevant_docs")).orderBy("quality")
    document = queries.select(F.struct(F.concat(F.lit("q"), "quality").alias("query"), F.lit("c").alias("category"), "relevant_docs", F.lit("").alias("notes")).alias("q")).agg(
        F.sort_array(F.collect_list("q")).alias("queries"))
    document.select(F.lit("d").alias("description"), F.lit("1").alias("version"), "queries").write.option("pretty", True).json(path)
    return evaluate.qrels_of(jsonl.read_ground_truth(spark, path))


def vectors_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of the names that aren't empty, saved and loaded; vectors have unit length."""
    path, key = _folder(spark), F.col("p_partkey")
    docs = _parts(spark, sf_dir).select(key.alias("id"), F.when(key % 9 == 0, "").otherwise(F.col("p_name")).alias("title"))
    vectors.save(vectors.build(docs, F.col("title")), path)
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.load(spark, path).select("doc_id", F.size("vec").cast("long").alias("dimensions"), F.round(length, 4).alias("length"))


COMPOUNDS = ["of the", "the of"]


def normalize_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case, entities and tags resolved, compounds joined, as SQL's functions do it."""
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_text(F.col("html"), COMPOUNDS[:1], as_sql=True).alias("normal"))


def segment_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit(" tai nghe tai "), F.col("p_name"))
    return _parts(spark, sf_dir).select("p_partkey", text.segment(name, ["tai nghe", "widget tai"]).alias("segmented"))


def remove_boilerplate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.concat(F.lit(" "), F.col("p_name"), F.lit("  " + text.BOILERPLATE + " x"))
    return _parts(spark, sf_dir).select("p_partkey", text.remove_boilerplate(F.when(F.col("p_partkey") % 3 == 0, long).otherwise(F.col("p_name"))).alias("kept"))


def clean_html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities beyond the common ones, named and numbered, in ten spellings by page."""
    shown = F.concat(F.lit("<p>a&eacute;b&#x41;&#66;&hellip;&euro;"), F.col("page_id").cast("string"), F.lit("&amp;lt;</p>&frac12;"))
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html(shown).alias("clean"))


def coerce_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    raw = _parts(spark, sf_dir).select(
        key, F.concat(F.lit(" "), "p_name", F.lit("\n"), "p_brand", F.lit("\r ")).alias("title"), _price().alias("price"),
        F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, 0).otherwise(_price() + 5).alias("original_price"), F.col("p_type").alias("platform"),
        F.when(key % 2 == 0, F.col("p_size")).alias("sold_count"))
    return products.coerced(raw).select("p_partkey", "title", "price", "original_price", "platform", "sold_count")


def index_text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    segmented, clean = F.when(key % 3 == 0, F.col("p_name")).when(key % 3 == 1, ""), F.when(key % 4 == 0, F.col("p_brand"))
    return _parts(spark, sf_dir).select("p_partkey", text.index_text(segmented, clean, F.col("p_type")).alias("chosen"))


def crawl_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to crawl of all pairs of a user and an event type that occur, and where to go on."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("platform"), F.col("event_type").alias("category"),
                                                F.col("value").cast("int").alias("page"), (F.col("event_id") % 3 == 0).alias("done"))
    return crawl_state.to_do(log.select("platform", "category").distinct(), log)


def normalize_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of two files under three sets of names, normalised and merged; records without a title, or with a count that isn't a number, go."""
    root, key = _folder(spark), F.col("p_partkey")
    parts, ident = _parts(spark, sf_dir), key.cast("string")
    new = _record(id=ident, title=F.col("p_name"), price=_price(), platform=F.col("p_type"), category=F.array("p_type", "p_brand"), sold_count=F.col("p_size"))
    old = _record(id=ident, name=F.col("p_name"), price=F.concat(_price().cast("string"), F.lit(".000 d")), source=F.col("p_type"), all_time_quantity_sold=F.col("p_size"))
    bad = F.when(key % 10 == 0, _record(id=ident, title=F.lit(""))).otherwise(_record(id=ident, title=F.col("p_name"), sold_count=F.lit("1.2k")))
    _lines(parts, F.when(key % 5 == 0, bad).otherwise(new), f"{root}/a")
    _lines(parts.where(key % 2 == 1), old, f"{root}/b")
    lines, _ = jsonl.read_ordered(spark, [f"{root}/a", f"{root}/b"])
    return products.merge(lines)[0].select("id", "title", "price", "original_price", "sold_count", "platform", "category")


def parse_tiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    made = F.to_json(F.struct(F.when(key % 7 > 0, key).alias("id"), F.col("p_name").alias("name"), _price().alias("price"), F.when(key % 2 == 0, _price() + 9).alias("list_price"),
                              F.struct(F.col("p_size").alias("value")).alias("quantity_sold"), F.concat(key.cast("string"), F.lit(".html")).alias("url_path"), F.lit("").alias("brand_name")))
    found = _parts(spark, sf_dir).select(products.parse_tiki(F.try_parse_json(made)).alias("p")).where("p IS NOT NULL")
    return found.select("p.id", "p.title", "p.price", "p.original_price", "p.sold_count", "p.link", "p.brand")


def parse_chotot(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    made = F.to_json(F.struct(F.when(key % 7 > 0, key).alias("list_id"), F.when(key % 5 > 0, F.concat("p_name", F.lit("\n"), "p_brand")).alias("subject"), _price().alias("price")))
    found = _parts(spark, sf_dir).select("p_partkey", products.parse_chotot(F.try_parse_json(made)).alias("p")).where("p IS NOT NULL")
    return found.select("p_partkey", "p.id", "p.title", "p.price", "p.link")


def parse_shopee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with and without a badge, with price ranges and thousands sold."""
    key = F.col("p_partkey")
    link = F.concat(F.lit("https://shopee.vn/x-i.1."), key.cast("string"), F.lit("?sp=1"))
    rest = [F.col("p_name"), F.concat(F.lit("₫"), F.format_number(_price() * 1000, 0), F.lit(" - ₫9.000.000")), F.concat(F.lit("Đã bán "), F.col("p_size").cast("string"), F.lit("k"))]
    card = F.when(key % 2 == 0, F.array(F.lit("Mall"), *rest)).otherwise(F.array(*rest))
    # Thousands are separated by dots there.
    card = F.transform(card, lambda x: F.translate(x, ",", "."))
    return _parts(spark, sf_dir).select(products.parse_shopee(link, card).alias("p")).select("p.id", "p.title", "p.price", "p.sold_count", "p.link")


def parse_ebay(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    card = F.concat(F.lit('<li><a class="s-item__link" href="https://www.ebay.com/itm/'), key.cast("string"), F.lit('?h=1"><div class="s-item__title">'),
                    F.when(key % 9 == 0, "Shop on eBay").otherwise(F.col("p_name")), F.lit('</div></a><span class="s-item__price">$'), F.format_number(_price(), 2),
                    F.lit('</span><img src="i.jpg">'), F.col("p_size").cast("string"), F.lit("+ sold</li>"))
    found = products.parse_ebay(_parts(spark, sf_dir).select(card.alias("html"), "p_brand"), "html", F.col("p_brand")).where("product IS NOT NULL")
    return found.select("product.id", "product.title", "product.price", "product.sold_count", "product.link", "product.category")


def expand_query_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shorthand before the first words of every turn, and codes of letters and digits after them."""
    start = F.substring_index(F.col("text"), " ", 5)
    asked = F.concat(F.lit("IP 14prm ss dt tn "), start, F.lit(" s24x--7 "), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.expand_query(asked).alias("expanded"))


def junk_title_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("bigint").cast("string")
    title = F.when(key % 5 == 0, F.concat(F.lit(" -"), price, F.lit("% "))).when(key % 5 == 1, F.concat(price, F.lit(".000đ"))).when(key % 5 == 2, F.concat(price, F.lit("VND"))).when(
        key % 5 == 3, "").otherwise(F.concat(F.lit("Order "), price))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.junk_title(title).alias("junk"))


#: Separators by part, and what a string of three levels splits into.
SEPARATORS = (" > ", " / ", " - ", ">", "/", "-")


def parse_category_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of three levels with each separator, one whose first separator in the list isn't the first in the text, a single level, and none."""
    key = F.col("p_partkey")
    out = F.when(key % 9 == 6, F.concat("p_type", F.lit(" - x > "), "p_brand")).when(key % 9 == 7, F.col("p_type")).when(key % 9 == 8, F.lit(None).cast("string"))
    for n, sep in enumerate(SEPARATORS):
        out = out.when(key % 9 == n, F.concat("p_type", F.lit(sep), "p_brand", F.lit(sep + " "), "p_name"))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(text.parse_category(out), "|").alias("levels"))


def category_tree_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of up to twenty levels below a part's type."""
    depth = (F.col("p_partkey") % 20).cast("int")
    tree = F.aggregate(F.sequence(F.lit(0), depth), F.concat(F.lit('{"title":"'), "p_type", F.lit('"}')), lambda s, n: F.concat(F.lit('{"name":"n'), n.cast("string"), F.lit('","parent":'), s, F.lit("}")))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(text.parse_category_tree(F.try_parse_json(tree)), "|").alias("levels"))


def ebay_price_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, whole = F.col("o_orderkey"), F.col("o_totalprice").cast("bigint")
    shown = F.when(key % 4 == 0, F.concat(F.lit("US $"), F.format_number(whole, 2), F.lit(" to $9"))).when(key % 4 == 1, F.concat(F.lit("1."), whole.cast("string"), F.lit(".25"))).when(key % 4 == 2, "free").otherwise(
        whole.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.ebay_price(shown).alias("price"))


def ebay_id_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    url = F.concat(F.when(key % 3 == 0, "https://e.com/x/").otherwise("https://e.com/itm/"), key.cast("string"), F.when(key % 2 == 0, "?y=1").otherwise("/z"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.ebay_id(url).alias("id"))


def gamma_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of two numbers one after the other, decoded."""
    bits = F.concat(codec.gamma_encode(F.col("event_id") + 1), codec.gamma_encode(F.col("user_id") + 1))
    return table(spark, sf_dir, "events").select("event_id", codec.gamma_decode(bits).alias("n")).select("event_id", F.col("n")[0].alias("first"), F.col("n")[1].alias("second"), F.size("n").alias("count"))


QUERIES = {f.__name__: f for f in (
    scan_strict, scan_lenient, scan_ordered, scan_folder_counts, append_unseen_ids, ground_truth_qrels, vectors_saved, normalize_text_pages, segment_parts, remove_boilerplate_parts,
    clean_html_entities, coerce_parts, index_text_choice, crawl_resume, normalize_merge, parse_tiki, parse_chotot, parse_shopee, parse_ebay, expand_query_turns, junk_title_orders,
    parse_category_parts, category_tree_parts, ebay_price_orders, ebay_id_orders, gamma_decode)}

_COST = "trunc(p_retailprice)::BIGINT"
_CLEAN = "lower(html)"
for _entity, _plain in text.ENTITIES.items():
    _CLEAN = "replace({}, '{}', '{}')".format(_CLEAN, _entity, _plain.replace("'", "''"))
_RUNS = f"regexp_extract_all(w, '([a-zA-Z{text.VIETNAMESE}]+|[0-9]+)')"
_SYNONYMS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in text.SYNONYMS.items()) + "}"

ORACLE_SQL = {
    "scan_strict": f"SELECT p_partkey::VARCHAR AS id, p_name AS title, {_COST} AS price FROM part",
    "scan_lenient": "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0",
    "scan_ordered": f"""SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 2 = 0 THEN 'first ' ELSE 'second ' END || p_name AS title, {_COST} AS price, 1 AS n_missing
        FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
    "scan_folder_counts": """SELECT source, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 1 THEN 'unknown' ELSE coalesce(source, 'unknown') END AS source FROM documents WHERE doc_id % 5 <> 0) GROUP BY source
        UNION ALL SELECT NULL, count(*) FROM documents""",
    "append_unseen_ids": "SELECT DISTINCT o_custkey::VARCHAR AS id, CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 1 END AS n FROM orders",
    "ground_truth_qrels": "SELECT quality AS query_id, doc_id::VARCHAR AS doc_id FROM labels",
    "vectors_saved": "SELECT p_partkey AS doc_id, 768::BIGINT AS dimensions, 1.0::DOUBLE AS length FROM part WHERE p_partkey % 9 <> 0 AND p_name <> ''",
    "normalize_text_pages": rf"""SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace({_CLEAN}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '\bof the\b', 'of_the', 'g') AS normal FROM pages""",
    "segment_parts": r"""SELECT p_partkey, CASE WHEN p_name LIKE '% widget' OR p_name = 'widget' THEN regexp_replace(p_name, 'widget$', 'widget_tai') || ' nghe tai ' || p_name
        ELSE p_name || ' tai_nghe tai ' || p_name END AS segmented FROM part""",
    "remove_boilerplate_parts": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN trim(p_name) ELSE p_name END AS kept FROM part",
    "clean_html_entities": "SELECT page_id, 'aébAB…€' || page_id || '&lt; ½' AS clean FROM pages",
    "coerce_parts": f"""SELECT p_partkey, p_name || ' ' || p_brand AS title, {_COST} AS price, {_COST} + CASE WHEN p_partkey % 3 = 2 THEN 5 ELSE 0 END AS original_price, lower(p_type) AS platform,
        CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END::BIGINT AS sold_count FROM part""",
    "index_text_choice": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_type END AS chosen FROM part",
    "crawl_resume": """WITH e AS (SELECT event_id, user_id::VARCHAR AS platform, event_type AS category, trunc(value)::INT AS page, event_id % 3 = 0 AS done FROM events),
        last AS (SELECT * FROM e ORDER BY event_id DESC LIMIT 1), finished AS (SELECT DISTINCT platform, category FROM e WHERE done)
        SELECT DISTINCT e.platform, e.category, CASE WHEN NOT last.done AND last.platform = e.platform AND last.category = e.category THEN last.page ELSE 0 END AS resume_page
        FROM e, last WHERE (e.platform, e.category) NOT IN (SELECT (platform, category) FROM finished)""",
    "normalize_merge": f"""WITH a AS (SELECT p_partkey % 5 <> 0 AS new, * FROM part) SELECT lower(p_type) || '_' || p_partkey AS id, p_name AS title,
        CASE WHEN new THEN {_COST} ELSE {_COST} * 1000 END AS price, CASE WHEN new THEN {_COST} ELSE {_COST} * 1000 END AS original_price, p_size::BIGINT AS sold_count, lower(p_type) AS platform,
        CASE WHEN new THEN p_type || ' > ' || p_brand ELSE '' END AS category FROM a WHERE new OR p_partkey % 2 = 1""",
    "parse_tiki": f"""SELECT 'tiki_' || p_partkey AS id, p_name AS title, {_COST} AS price, {_COST} + CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 0 END AS original_price, p_size::BIGINT AS sold_count,
        'https://tiki.vn/' || p_partkey || '.html' AS link, 'No Brand' AS brand FROM part WHERE p_partkey % 7 > 0""",
    "parse_chotot": f"""WITH t AS (SELECT *, CASE WHEN p_partkey % 7 > 0 THEN p_partkey::VARCHAR ELSE 'None' END AS raw FROM part WHERE p_partkey % 5 > 0)
        SELECT p_partkey, 'chotot_' || raw AS id, p_name || ' ' || p_brand AS title, {_COST} AS price, 'https://www.chotot.com/' || raw || '.htm' AS link FROM t""",
    "parse_shopee": f"""SELECT 'shopee_1.' || p_partkey AS id, p_name AS title, {_COST} * 1000 AS price, p_size::BIGINT * 1000 AS sold_count, 'https://shopee.vn/x-i.1.' || p_partkey AS link FROM part""",
    "parse_ebay": f"""SELECT 'ebay_' || p_partkey AS id, p_name AS title, {_COST} AS price, p_size::BIGINT AS sold_count, 'https://www.ebay.com/itm/' || p_partkey AS link, p_brand AS category
        FROM part WHERE p_partkey % 9 <> 0""",
    "expand_query_turns": rf"""WITH q AS (SELECT conv_id, turn, lower('IP 14prm ss dt tn ' || array_to_string(string_split(text, ' ')[1:5], ' ') || ' s24x--7 ' || turn) AS q FROM conversations),
        r AS (SELECT conv_id, turn, flatten(list_transform(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> ''), lambda w: CASE WHEN len({_RUNS}) > 0 THEN {_RUNS} ELSE [w] END)) AS t FROM q)
        SELECT conv_id, turn, array_to_string(list_transform(t, lambda x: coalesce({_SYNONYMS}[x], x)), ' ') AS expanded FROM r""",
    "junk_title_orders": "SELECT o_orderkey, o_orderkey % 5 < 3 AS junk FROM orders",
    "parse_category_parts": """SELECT p_partkey, CASE p_partkey % 9 WHEN 6 THEN p_type || ' - x|' || p_brand WHEN 7 THEN p_type WHEN 8 THEN '' ELSE p_type || '|' || p_brand || '|' || p_name END AS levels FROM part""",
    "category_tree_parts": "SELECT p_partkey, array_to_string(list_transform(range(p_partkey % 20, -1, -1), lambda i: 'n' || i), '|') || '|' || p_type AS levels FROM part",
    "ebay_price_orders": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN p::DOUBLE WHEN 1 THEN ('1' || p || '.25')::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE p::DOUBLE END AS price
        FROM (SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS p FROM orders)""",
    "ebay_id_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::VARCHAR END AS id FROM orders",
    "gamma_decode": "SELECT event_id, event_id + 1 AS first, user_id + 1 AS second, 2 AS count FROM events",
}
