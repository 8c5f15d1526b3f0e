"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from newswell.plans import catalog

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def shown(df):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "null"
        return repr(round(float(v), 9)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = df.toPandas()
    if name not in SQL:
        assert len(got) and list(got.columns) == df.columns
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


#: References with and without a semicolon, numbers of all kinds, names that only open a word, and white space of Unicode.
ODD = ["&amp", "&amp;lt; &ampx &am &", "&eacute;t&eacute &copy2 &notit; &notin; &NotEqualTilde;", "&#150;&#0;&#x110000;&#55296;&#1;&#xD;&#X41&#65;z&#00000000065;&#99999999999;", "&;&#;&#x;&#xg;", "&&amp;&amp;amp;", " a\x0b\x85&nbsp;b　", "&CounterClockwiseContourIntegral; &abcdefghijklmnopqrstuvwxyzabcdefghijkl;", "&lt;b&gt;x&lt;/b&gt; &fjlig;", "", "&apos;&NewLine;&Tab;"]


@pytest.mark.parametrize("name", ["f01_clean_text", "f03_unescape", "s03b_feeds_from_bytes", "s06_open_graph", "s06t_open_graph_tags"])
def test_references_of_the_standard_equal_sql(spark, tmp_path, name):
    pages = [(k * 7 + i, f"http://a.example/{k}", f'<title>{x}</title><p>{x} y</p><meta name="description" content="{x}">') for k, x in enumerate(ODD) for i in range(7)] + [(1000, "http://b.example/", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want, got = c.execute(SQL[name]).df(), QUERIES[name](spark, str(tmp_path)).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 40
    assert shown(got) == shown(want)
