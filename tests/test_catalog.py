"""Every query of the catalogue that has SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from newsloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 6)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs_twice_alike(spark, name):
    one, two = (catalog.QUERIES[name](spark, SF) for _ in range(2))
    assert rows(one.columns, one.collect()) == rows(two.columns, two.collect())


@pytest.mark.parametrize("name", ["page_title", "title_priority"])
def test_titles_with_entities_and_odd_spaces_match_sql(spark, tmp_path, name):
    """Entities other than the ampersand's stay, and only the space separators of Unicode are cut off at the ends."""
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace() or c in (0x180E, 0x200B, 0x2060)] + ["\ufeff"]
    titles = ["&quot;the&quot; x", "a &lt;the&gt; b", "&#39;de&#39;", "&nbsp;the&nbsp;", "&amp;quot;the", "&amp;amp; the", "&AMP; the", "&amp;nbsp;", "   ", "", "a\nb", *[f"{c} {c}the x{c}y {c}" for c in spaces]]
    pages = [(k, f"<TITLE lang='x'>{t}</Title><title>later</title>") for k, t in enumerate(titles)] + [(-1, None), (-2, ""), (-3, "<title>the"), (-4, "<title\n>\U0001f600 the </title >x</title>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
