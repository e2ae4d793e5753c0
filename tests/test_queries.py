"""Each registered query of the engine against its oracle, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from tidewell.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def canon(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(registry.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    expected = [tuple(r[order.index(c)] for c in names) for r in found.fetchall()]
    assert canon(map(tuple, df.select(*names).collect())) == canon(expected)


ODD_PAGES = [None, "", "\xa0 of the\u2003", "\x0bof\x0bthe\x0b", "of\xa0the a\xa0\xa0b", "éof the", "of theé of the_ of the2 of the²", "Of The<b>of the</b> of\n\tthe of the",
             "&eacute; &#233; &#x41; &hellip; &NBSP;x&nbsp;&amp;lt; &amp &am", "&#39; &#39 &quo &copy; a &Copy b", "ΟΔΟΣ ΣΑΣ, İstanbul ẞ", "a < b <> c <d\ne> f <g", "\u3000<p>\u3000x\x85</p>\x1c"]


def test_normalize_text_pages_matches_oracle_on_odd_pages(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD_PAGES)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = registry.QUERIES["normalize_text_pages"](spark, str(tmp_path)).select("page_id", "normal").orderBy("page_id").collect()
    assert list(map(tuple, found)) == con.execute(registry.ORACLE_SQL["normalize_text_pages"] + " ORDER BY page_id").fetchall()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
