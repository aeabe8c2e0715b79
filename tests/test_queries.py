"""Every query runs, and gives the rows of its SQL in DuckDB where it has one; the library works without the llm subpackage."""

import datetime
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sitelens.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10]
    if isinstance(v, (bool, str)):
        return v
    return round(float(v), 6) if hasattr(v, "__float__") else str(v)


def rows(frame):
    return sorted(([plain(v) for v in r] for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_html_fields_of_references(spark, tmp_path):
    """References other than the SQL's three, ones cut off, ones written twice; in titles, headings, links."""
    texts = ["a &quot;b&quot; &lt;c&gt; &amp;", "cut &amp", "cut &lt", "&amp;lt; &amp;amp;", "&&& &#39;x&#39; &copy &nbsp; y", "plain"]
    pages = [(i, "http://a.org/", f'<html lang="en"><head><title>{t}</title></head><body><h1>{t}</h1><a href="/q?a=1&amp;b=2&copy=3">{t}</a></body></html>') for i, t in enumerate(texts)]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    got = QUERIES["html_fields"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    assert rows(got) == rows(con.execute(ORACLE_SQL["html_fields"]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm():
    code = "import sys; sys.modules['sitelens.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q), q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
