"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from crawlens.plans import registry

DIR = "/root/testdata/sf0.001"


def norm(rows):
    return sorted(tuple(f"{v + 0.0:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    exp = oracle.sql(registry.ORACLES[name])
    assert sorted(exp.columns) == cols
    quoted = [f'"{c}"' for c in cols]
    assert norm(got.select(*cols).collect()) == norm(exp.select(*quoted).fetchall())


def test_page_facts_with_references(spark, tmp_path):
    """Titles with references other than &amp;, and cut within one."""
    rows = [(1, "https://e.com", "<title>a &amp;&amp; b &amp</title><body><h1>t = &quot;x&quot; &am</h1><a href=\"/p?a=1&amp;b=2\">y</a>"), (2, "https://e.com", "<title>&lt;x&quot</title><body>&amp;")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.QUERIES["page_facts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    exp = con.sql(registry.ORACLES["page_facts"])
    cols = sorted(got.columns)
    assert norm(got.select(*cols).collect()) == norm(exp.select(*[f'"{c}"' for c in cols]).fetchall())
