"""Index, ranking, search, evaluation and preparation on small tables with exact results."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import literals
from tidewell.functions.text import index_text
from tidewell.operators import dedup, evaluate, index, ranking, search, vectors
from tidewell.sources import jsonl, products
from tidewell.streaming import crawl_state, ingest

LISTINGS = [("s1", "iPhone 15 Pro Max", "iphone 15 pro max", 25000000, "shopee"), ("s2", "Samsung Galaxy S24", "samsung galaxy s24", 20000000, "tiki"),
            ("s3", "Tai nghe iPhone chính hãng", "tai_nghe iphone chính_hãng", 500000, "shopee")]


@pytest.fixture(scope="module")
def listings(spark):
    return spark.createDataFrame(LISTINGS, "id string, title string, title_segmented string, price long, platform string").withColumns(
        {c: F.lit(None).cast("string") for c in ("title_clean", "category", "link", "image_url")})


@pytest.fixture(scope="module")
def engine(listings):
    text = index_text(F.col("title_segmented"), F.col("title_clean"), F.col("title"))
    return search.SearchEngine(index.build(listings, text, "id", check_ids=True), search.doc_store(listings), compounds=["tai nghe"])


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
    return out


def test_search_finds_and_ranks(spark, engine):
    got = by_query(engine.search(queries(spark, "iphone", "xyznonexist", "ss galaxy")))
    assert got == {0: [("s3", 0.4943), ("s1", 0.428)], 2: [("s2", got[2][0][1])]}
    assert engine.search_one(spark, "tai nghe").first()["title"] == "Tai nghe iPhone chính hãng"


def test_mode_without_vectors_is_bm25(spark, engine):
    engine.set_mode("hybrid")
    assert [d for d, _ in by_query(engine.search(queries(spark, "iphone")))[0]] == ["s3", "s1"]
    engine.set_mode("bm25")
    with pytest.raises(ValueError):
        engine.set_mode("other")


def hand_built(spark):
    posted = [("iphone", "doc1", 3), ("iphone", "doc2", 1), ("samsung", "doc2", 2), ("samsung", "doc3", 1), ("điện_thoại", "doc1", 2), ("điện_thoại", "doc2", 1), ("điện_thoại", "doc3", 1)]
    return index.Index(spark.createDataFrame(posted, "term string, doc_id string, tf long"), spark.createDataFrame([("doc1", 8), ("doc2", 6), ("doc3", 5)], "doc_id string, dl long"),
                       spark.createDataFrame([(3, 6.33)], "n_docs long, avgdl double"))


def test_bm25_values(spark):
    got = by_query(ranking.bm25(queries(spark, "iphone điện_thoại", "iphone", "iphone iphone", "nothing"), hand_built(spark), 10, 1.5, 0.75))
    assert got == {0: [("doc1", 0.910718), ("doc2", 0.618034), ("doc3", 0.147475)], 1: [("doc1", 0.73487), ("doc2", 0.481295)], 2: [("doc1", 1.469741), ("doc2", 0.962589)]}
    idfs = {r["term"]: round(r["idf"], 6) for r in index.term_stats(hand_built(spark).postings, hand_built(spark).stats).collect()}
    assert idfs == {"iphone": 0.470004, "samsung": 0.470004, "điện_thoại": 0.133531}


def test_term_counts_and_empty_documents(spark):
    docs = spark.createDataFrame([("x", "iPhone 15 pro iphone"), ("y", "a b c"), ("z", None)], "doc_id string, text string")
    own = index.build(docs, F.col("text"))
    assert {(r["term"], r["tf"]) for r in own.postings.collect()} == {("iphone", 2), ("15", 1), ("pro", 1)}
    assert own.stats.first() == Row(n_docs=1, avgdl=4.0)


def test_repeated_ids_are_found(spark):
    docs = spark.createDataFrame([("x", "one two"), ("x", "three")], "doc_id string, text string")
    with pytest.raises(ValueError):
        index.build(docs, F.col("text"), check_ids=True)


def test_compression_bytes_and_round_trip(spark, tmp_path):
    posted = [("iphone", "doc1", 3), ("iphone", "doc2", 1), ("iphone", "doc3", 2), ("samsung", "doc2", 2), ("samsung", "doc3", 1), ("tai_nghe", "doc1", 1)]
    df = spark.createDataFrame(posted, "term string, doc_id string, tf long")
    compressed, ids = index.compress(df)
    assert {r["term"]: bytes(r["data"]).hex() for r in compressed.collect()} == {"iphone": "818381818182", "samsung": "82828181", "tai_nghe": "8181"}
    assert sorted(map(tuple, index.decompress(compressed, ids).select("term", "doc_id", "tf").collect())) == sorted(posted)
    own = index.Index(df, spark.createDataFrame([("doc1", 4), ("doc2", 3), ("doc3", 3)], "doc_id string, dl long"), None)
    index.save(own, str(tmp_path))
    plain = sorted(map(tuple, index.load(spark, str(tmp_path)).postings.select("term", "doc_id", "tf").collect()))
    index.save_compressed(own, str(tmp_path))
    assert sorted(map(tuple, index.load(spark, str(tmp_path)).postings.select("term", "doc_id", "tf").collect())) == plain == sorted(posted)
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path / "none"))


def ranked(spark, *ids):
    return spark.createDataFrame([(1, d, n) for n, d in enumerate(ids, 1)], "query_id int, doc_id string, rank int")


@pytest.mark.parametrize("weights, expected", [
    ((0.5, 0.5), {"doc1": 1.653005, "doc2": 1.653005, "doc3": 1.600102, "doc5": 0.806452, "doc4": 0.793651}),
    ((0.8, 0.2), {"doc1": 1.661202, "doc2": 1.644809, "doc3": 1.607783, "doc4": 1.269841, "doc5": 0.322581}),
    ((0.6, 0.4), {"doc1": 1.655738, "doc2": 1.650273, "doc3": 1.602663, "doc4": 0.952381, "doc5": 0.645161})])
def test_fusion(spark, weights, expected):
    w = spark.createDataFrame([(1, *weights)], "query_id int, bm25_weight double, vector_weight double")
    got = ranking.rrf(ranked(spark, "doc1", "doc2", "doc3", "doc4"), ranked(spark, "doc2", "doc1", "doc5", "doc3"), w)
    assert dict(by_query(got)[1]) == expected


def test_knn_against_native_product(spark):
    rng = random.Random(1)
    rows = [(n, [rng.uniform(-1, 1) for _ in range(8)]) for n in range(60)] + [(60, None)]
    vectors = spark.createDataFrame(rows, "doc_id int, vec array<float>")
    asked = vectors.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), "vec")
    got = by_query(ranking.knn(asked, vectors, 4))
    native = ranking.top(asked.crossJoin(vectors.where("vec IS NOT NULL").withColumnRenamed("vec", "v")).select("query_id", "doc_id", ranking.dot(F.col("vec"), F.col("v")).alias("score")), 4)
    assert got == by_query(native) and all(len(v) == 4 for v in got.values())
    assert ranking.knn(asked.limit(0), vectors, 4).count() == 0


def loop_diversify(results, k, cap):
    """The round-robin as a loop, to compare with."""
    if len(results) <= k:
        return results
    lists = {}
    for r in results:
        lists.setdefault(r[1], []).append(r)
    if len(lists) < 2:
        return results[:k]
    out, taken, rounds = [], dict.fromkeys(lists, 0), 0
    while len(out) < k and rounds <= 50:
        rounds, before = rounds + 1, len(out)
        for p, items in lists.items():
            if len(out) < k and taken[p] < min(cap, len(items)):
                out.append(items[taken[p]])
                taken[p] += 1
        cap += len(out) == before
    return out


def test_diversify(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for q in range(40):
        listed = [(n, rng.choice("ABC"[: rng.randrange(1, 4)])) for n in range(rng.randrange(1, 90))]
        expected[q] = [n for n, _ in loop_diversify(listed, 10 + q, 3)]
        rows += [(q, n, p, n + 1, 10 + q) for n, p in listed]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, platform string, rank int, k int")
    for q in range(40):
        got = search.diversify(df.where(F.col("query_id") == q), 10 + q, 3).orderBy("rank")
        assert [r["doc_id"] for r in got.collect()] == expected[q]
        if q > 8:
            break


def test_offers(spark, engine):
    page = engine.offers(queries(spark, "iphone"), ["shopee"], 0, 1_000_000, by="price_desc")
    assert [(r["doc_id"], r["position"], r["pages"]) for r in page.collect()] == [("s3", 1, 1)]


def test_optional_boost_and_floor(spark):
    hits = spark.createDataFrame([(0, "a", "red phone with many other words in its title", 9.0, 1), (0, "b", "red phone", 8.0, 2), (0, "c", "", 1.0, 3)],
                                 "query_id int, doc_id string, title string, score double, rank int")
    boosted = search.coverage_boost(hits, queries(spark, "red phone"))
    assert [(r["doc_id"], round(r["score"], 6)) for r in boosted.orderBy("rank").collect()] == [("b", 14.4), ("a", 2.7), ("c", 0.3)]
    assert [r["doc_id"] for r in search.score_floor(boosted).collect()] == ["b"]


def measured(spark, retrieved, relevant, k):
    got = spark.createDataFrame([(1, d, n) for n, d in enumerate(retrieved, 1)], "query_id int, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, d) for d in relevant], "query_id int, doc_id string")
    row = evaluate.metrics(spark.createDataFrame([(1,)], "query_id int"), got, qrels, k).first()
    return {m: round(row[m], 6) for m in ("precision", "recall", "f1", "ndcg", "reciprocal_rank")} | ({"short": row["precision_short"]} if k == 10 else {})


def test_metrics(spark):
    assert measured(spark, ["d1", "d4", "d2", "d5", "d6"], ["d1", "d2", "d3"], 5)["precision"] == 0.4
    assert measured(spark, ["d1", "d4", "d5"], ["d1", "d2", "d3", "d3"], 3)["recall"] == 0.333333
    assert measured(spark, ["d1", "d3", "d2"], ["d1", "d2"], 3)["ndcg"] == 0.919721
    assert measured(spark, ["d1", "d2", "d3"], ["d1", "d2", "d3"], 10)["precision"] == 0.3
    assert measured(spark, ["d1", "d2"], ["d1", "d2"], 2)["f1"] == 1.0
    assert measured(spark, ["d9", "d8", "d1"], ["d1"], 2) == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "ndcg": 0.0, "reciprocal_rank": 0.333333}
    for k, relevant in ((0, ["d1"]), (5, [])):
        row = measured(spark, ["d1"], relevant, k)
        assert (row["recall"], row["ndcg"]) == (0.0, 0.0)
    empty = evaluate.metrics(spark.createDataFrame([], "query_id int"), ranked(spark, "a"), ranked(spark, "a").select("query_id", "doc_id"), 5)
    assert evaluate.summary(empty).first()["mrr"] == 0.0


def test_ground_truth_file(spark, tmp_path):
    (tmp_path / "gt.json").write_text('{"description": "d",\n "queries": [{"query": "a", "relevant_docs": ["x", "y"]}, {"query": "b", "relevant_docs": []}]}')
    got = evaluate.qrels_of(jsonl.read_ground_truth(spark, str(tmp_path / "gt.json")))
    assert sorted(map(tuple, got.collect())) == [(0, "x"), (0, "y")]


def test_keep_latest(spark):
    rows = [("x", "2024-01-01", 0), ("x", "2024-02-01", 1), ("x", "2024-02-01", 2), (None, "2024-03-01", 3), ("y", None, 4)]
    df = spark.createDataFrame(rows, "id string, crawled_at string, pos int")
    assert sorted(r["pos"] for r in dedup.keep_latest(df, ["id"], "crawled_at", "pos").collect()) == [1, 4]
    report = {r["file"]: (r["before"], r["after"], r["removed"], r["percent"]) for r in dedup.report(df.withColumn("file", F.lit("f")), ["id"], "file").collect()}
    assert report == {"f": (5, 2, 3, 60.0), None: (5, 2, 3, 60.0)}


def test_normalise_and_merge(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "title": "A", "platform": "Tiki"}\nnot json\n\n{"id": "1", "title": "B", "platform": "tiki"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": "tiki_1", "name": "C", "source": "tiki"}\n{"id": "2", "name": "D", "price": "1.000 d"}\n{"id": "3"}\n')
    lines, missing = jsonl.read_ordered(spark, [str(tmp_path / n) for n in ("a.jsonl", "none.jsonl", "b.jsonl")])
    assert missing == [str(tmp_path / "none.jsonl")]
    kept, rejected = products.merge(lines)
    assert sorted((r["id"], r["title"], r["price"]) for r in kept.collect()) == [("2", "D", 1000), ("tiki_1", "A", 0)]
    assert sorted(r["value"] for r in rejected.collect()) == ["", "not json", '{"id": "3"}']
    assert {r["source"]: r["n"] for r in jsonl.counts(jsonl.read_folder(spark, str(tmp_path))).collect()} == {"unknown": 4, "tiki": 1, None: 7}


def test_strict_scan_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\nnot json\n')
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(tmp_path / "bad.jsonl")).collect()


def test_append_unseen(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "id string, n int")
    jsonl.append_unseen(first, path)
    jsonl.append_unseen(spark.createDataFrame([("a", 4), ("b", 5)], "id string, n int"), path)
    assert sorted(r["id"] for r in spark.read.json(path).collect()) == ["a", "b"]


def test_coercion(spark):
    df = spark.createDataFrame([(" A\nb\r", 5, 0, "TIKI", None)], "title string, price int, original_price int, platform string, sold_count int")
    row = products.coerced(df).first()
    assert (row["title"], row["original_price"], row["platform"], row["sold_count"]) == ("A b", 5, "tiki", 0)


def test_fixed_records(spark):
    assert sorted(map(tuple, literals.normalized(spark).collect())) == sorted(r for _, r in literals.RECORDS if r)
    assert sorted(map(tuple, literals.parsed(spark).collect())) == sorted([literals.TIKI[1], literals.CHOTOT[1], literals.SHOPEE[1], literals.EBAY[1]])


def test_store_is_not_shuffled_by_enriching(spark, engine):
    """The hits filter the store where it lies: no exchange of the store by key, and no join of it but by a broadcast."""
    hits = engine.ranked(engine.understood(queries(spark, "iphone")), 50)
    plan = search.enrich(hits, spark.range(1000).select(F.col("id").cast("string").alias("doc_id"), *(F.lit("").alias(c) for c in search.DISPLAY), F.lit(0).cast("long").alias("price")), 10, 50)
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shown and "Range" in shown
    at = shown.splitlines()
    line = next(k for k, x in enumerate(at) if "Range (0, 1000" in x)
    above = [x for x in at[:line] if x.index(x.lstrip(" :+-")[:1]) < at[line].index("Range")]
    assert "LeftSemi" in "".join(above[-4:]) and "hashpartitioning(doc_id" not in "".join(above[-4:])


def test_lists_and_gaps_by_blocks(spark):
    posted = spark.createDataFrame([("t", d, 1 + d % 3) for d in range(0, 50, 3)] + [("u", 49, 2)], "term string, doc_id long, tf long")
    ids = index.doc_id_map(posted)
    lists = index.posting_lists(posted, ids, 4)
    assert all(r["df"] == len(r["postings"]) <= 4 for r in lists.collect()) and lists.where("term = 't'").count() == 5
    for size in (1, 4, 1000):
        gaps = {(r["term"], r["int_id"]): r["gap"] for r in index.posting_gaps(posted, ids, size).collect()}
        assert gaps == {("t", n): 1 for n in range(1, 18)} | {("u", 18): 18}
        assert sorted(map(tuple, index.decompress(*index.compress(posted, size)).select("term", "doc_id", "tf").collect())) == sorted(map(tuple, posted.collect()))


def test_parsers_reject(spark):
    v = literals.variants(spark, [{"name": "no id"}, {"id": 0}])
    assert [r[0] for r in v.select(products.parse_tiki(F.col("v"))).collect()] == [None, None]
    cards = spark.createDataFrame([("<div class='s-item__title'>Shop on eBay</div><a class='s-item__link' href='/itm/1'></a>",), ("<p>",), (None,)], "html string")
    assert [r["product"] for r in products.parse_ebay(cards, "html", F.lit("k")).collect()] == [None, None, None]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    one = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "id string")
    one.write.json(source)
    ingest.ingest(spark, source, out, state, one.schema).awaitTermination()
    spark.createDataFrame([("b",), ("c",)], "id string").write.mode("append").json(source)
    ingest.ingest(spark, source, out, state, one.schema).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_crawl_goes_on_from_the_last_page(spark):
    log = spark.createDataFrame([(1, "tiki", "a", 3, False), (2, "tiki", "a", 3, True), (3, "tiki", "b", 7, False)], crawl_state.EVENT)
    categories = spark.createDataFrame([("tiki", "a"), ("tiki", "b"), ("tiki", "c")], "platform string, category string")
    assert sorted((r["category"], r["resume_page"]) for r in crawl_state.to_do(categories, log).collect()) == [("b", 7), ("c", 0)]
    seen = spark.createDataFrame([("x",), ("x",), ("y",)], "id string")
    assert crawl_state.stats(log, seen).first() == Row(total_crawled_products=2, completed_categories=1, current_category="b", last_page=7)
    assert crawl_state.stats(log.limit(0), seen).first() == Row(total_crawled_products=2, completed_categories=0, current_category=None, last_page=0)


def test_vectors(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red phone case"), ("b", "red phone"), ("c", "blue sofa"), ("d", ""), (None, "x"), ("e", None)], "id string, title string")
    vectors.save(vectors.build(docs, F.col("title")), str(tmp_path / "v"))
    own = vectors.load(spark, str(tmp_path / "v"))
    assert vectors.check(own).first() == Row(n=3, n_ids=3, least_dimensions=768, most_dimensions=768, n_bytes=3 * 768 * 4)
    assert all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-5 for r in own.collect())
    asked = vectors.embed(queries(spark, "red phone"), F.col("query"), vectors.hashing_embedder)
    assert [d for d, _ in by_query(ranking.knn(asked, own, 2))[0]] == ["b", "a"]


def test_vector_and_hybrid_modes(spark, engine, listings):
    own = vectors.build(listings, F.col("title"))
    both = search.SearchEngine(engine.index, engine.store, own, lambda q: vectors.embed(q, F.col("query"), vectors.hashing_embedder), mode="vector")
    assert [d for d, _ in by_query(both.search(queries(spark, "samsung galaxy s24")))[0]] == ["s2"]
    both.set_mode("hybrid")
    got = by_query(both.search(queries(spark, "samsung galaxy")))[0]
    assert got == [("s2", round(100 * 1.0 / 60, 4))]
