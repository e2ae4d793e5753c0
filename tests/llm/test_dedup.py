"""Exact and near duplicates against brute force."""

import hashlib
import os
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, graph, queries, simhash
from tidewell.llm.common import numbered

SF = "/root/testdata/sf0.001"
driver_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@driver_tables
def test_exact_matches_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op9_exact_dedup"]).fetchall()
    got = queries.QUERIES["op9_exact_dedup"](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)


TEXTS = ["É a", "é a", "É A", "x", None, "", "X", "ﬁ", "ẞ", "ß", "x" * 5000, "X" * 5000]


def exact_brute(texts, keep):
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(fold(t), []).append(k)
    return sorted((k, keep(groups[fold(t)]), len(groups[fold(t)]), k == keep(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for k, t in enumerate(texts))


@pytest.mark.parametrize("keep, pick", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_with_collisions(spark, table, keep, pick, weak):
    """With a hash of one hexadecimal digit nearly all groups hold several texts."""
    hashed = (lambda c: F.substring(F.md5(c), 1, 1)) if weak else exact_dedup.content_hash
    got = exact_dedup.exact_duplicates(table(TEXTS * 2), keep=keep, hashed=hashed).drop("row")
    assert sorted(map(tuple, got.collect())) == exact_brute(TEXTS * 2, pick)


def test_numbers_stay_however_a_scan_is_dealt(spark, tmp_path):
    """Rows of several files keep their numbers when splits are cut otherwise; so do the rows that exact and near stages drop, and what is sanitised."""
    rows = [(k, f"text number {k % 37} of some words that repeat often and once more mail{k % 5}@x.example.com", "en", "s", 1) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7).write.parquet(str(tmp_path / "d"))
    settings = {"spark.sql.files.maxPartitionBytes": ("134217728", "700"), "spark.sql.files.openCostInBytes": ("4194304", "1"), "spark.sql.files.minPartitionNum": ("1", "40")}
    usual = {k: spark.conf.get(k, None) for k in settings}
    try:
        def under(n):
            for k, v in settings.items():
                spark.conf.set(k, v[n])

        docs = spark.read.parquet(str(tmp_path / "d"))
        seen, parts = [], []
        for n in (0, 1):
            under(n)
            own = numbered(docs.select("doc_id", "text").where("doc_id >= 0"), "row")
            seen.append({r["doc_id"]: r["row"] for r in own.collect()})
            parts.append(spark.read.parquet(str(tmp_path / "d")).rdd.getNumPartitions())
        assert seen[0] == seen[1] and len(set(seen[0].values())) == 400 and parts[0] < parts[1]
        # A plan made under one setting and run under the other.
        under(0)
        own = numbered(docs, "row")
        flags = exact_dedup.exact_duplicates(own, row_col="row")
        under(1)
        assert {r["id"] for r in flags.where("kept").select(F.col("doc_id").alias("id")).collect()} == set(range(185))
        # Tables that aren't files are numbered once, in a copy.
        other = numbered(spark.range(50).repartition(3).withColumn("text", F.lit("x")), "row")
        assert other.agg(F.countDistinct("row")).first()[0] == 50 and other._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_hot_groups_are_compared_under_several_keys(spark, table, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT", 5)
    texts = ["same"] * 40 + ["Same"] * 3 + ["other", None, ""]
    for weak in (False, True):
        hashed = (lambda c: F.lit("0")) if weak else exact_dedup.content_hash
        got = exact_dedup.exact_duplicates(table(texts), hashed=hashed).drop("row")
        assert sorted(map(tuple, got.collect())) == exact_brute(texts, min)


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return 0
    shingles = [" ".join(words[k: k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, budget):
    label = {k: k for k in prints}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {k: root(k) for k in ids}


def test_fingerprint_hash_is_sparks(spark):
    assert spark.sql("SELECT xxhash64('a b c d')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_near_duplicates_against_brute_force(spark, table, rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 200))) for _ in range(25)]
    for base in list(texts):
        for _ in range(3):
            copy = base.split(" ")
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper())
    texts += ["", None, "one two", "One  two", "\x0bone\ttwo ", "é É", "one\x1ctwo"]
    prints = {k: fingerprint(t) for k, t in enumerate(texts)}
    want = components(prints, 4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(texts)).collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k for k, r in got.items() if r["kept"]} == set(want.values())
    assert len(set(want.values())) < len(texts) - 20


@pytest.mark.parametrize("cell", [2048, 12])
def test_links_of_clusters(spark, rng, cell):
    """Crowded fingerprints: partitions over the limit are divided, and no component is lost."""
    prints = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(90):
            x = base
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in prints}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    ties = {r["u"]: r["v"] for r in graph.components(simhash.links(df, 4, cell)).collect()}
    got, want = {x: ties.get(x, x) for x in signed}, components(signed, 4)
    assert len({(got[x], want[x]) for x in signed}) == len(set(want.values())) == len(set(got.values()))


@pytest.mark.parametrize("most", [graph.EDGES, 10])
def test_components_of_paths_and_stars(spark, most):
    """In one task, and by contraction."""
    edges = [(k + 1, k) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(200, 200)]
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(edges, "u long, v long"), most).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 150)}
