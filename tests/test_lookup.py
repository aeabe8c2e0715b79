"""Indexes and layouts: what they find, and how little they read for it."""

import random
import re

from pyspark.sql import functions as F

from sitelens.operators import stats
from sitelens.operators.text_index import TextIndex, find_page
from sitelens.sources import crawl_store


def leaves(df):
    """Rows that a query's scans have given out, when it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = plan.collectLeaves()
    return sum(found.apply(i).metrics().apply("numOutputRows").value() for i in range(found.size()) if "Scan" in found.apply(i).nodeName())


def test_text_index(spark, tmp_path):
    """Every term is found where contains() finds it: rare, frequent, short, absent, with capitals and other scripts, in any column."""
    rng = random.Random(2)
    words = ["blog", "shop", "Ünïcode", "news", "a", "ab", "x-1", "产品", "page", "zebra"]
    rows = [(i, "https://www.site.com/" + "/".join(rng.choices(words, k=rng.randint(0, 3))) + str(i), rng.choice([None, "", "ab", " ".join(rng.choices(words, k=4))])) for i in range(400)]
    pages = spark.createDataFrame(rows, "id long, normalized_url string, title string")
    index = TextIndex.build(pages, str(tmp_path / "i"), ["normalized_url", "title"])
    for term in ("blog", "BLOG", "ünï", "产品", "zebra page", "ab", "a", "www", "site.com/shop", "nothing here", "%", "", "399", "x-1"):
        want = {i for i, u, t in rows if term.lower() in u.lower() or t is not None and term.lower() in t.lower()}
        assert {r["id"] for r in index.search(term).collect()} == want, term
    plan = index.candidates("zebra")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(gram", plan)
    posted = spark.read.parquet(str(tmp_path / "i" / "postings")).count()
    assert leaves(index.candidates("site.com/shop")) < posted / 4
    assert find_page(index, "https://www.site.com/SHOP").count() <= 1
    url = rows[7][1]
    assert [r["id"] for r in find_page(index, url).collect()] == [7]
    empty = TextIndex.build(pages.where("false"), str(tmp_path / "e"), ["title"])
    assert empty.search("a").count() == 0 == empty.search("blog").count()


def test_lookup_reads_one_row_group(spark, tmp_path):
    """A page of one crawl among many: other crawls' folders and most row groups aren't read; a crawl written again replaces its folder."""
    at = str(tmp_path / "crawls")
    pages = spark.range(60_000).selectExpr("concat('c', id % 3) AS crawl_id", "id", "concat('https://a.com/', id) AS normalized_url", "sha2(concat('https://a.com/', id), 256) AS url_hash", "repeat(uuid(), 4) AS title")
    crawl_store.write_crawl(pages, at, row_group=64 << 10)
    found = crawl_store.lookup(spark, at, "c1", "https://A.com/40000?utm_source=x#y")
    assert [(r["id"], r["crawl_id"]) for r in found.collect()] == [(40_000, "c1")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*crawl_id[^\]]*c1", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(url_hash", plan)
    assert leaves(crawl_store.lookup(spark, at, "c1", "https://a.com/40000")) < 20_000 / 5
    assert leaves(crawl_store.lookup(spark, at, "c1", "https://a.com/none")) == 0  # statistics and Bloom filters rule it out
    assert crawl_store.read_crawl(spark, at).count() == 60_000 and crawl_store.read_crawl(spark, at, "c2").count() == 20_000
    crawl_store.write_crawl(pages.where("crawl_id = 'c1' AND id < 300"), at)
    assert {r["crawl_id"]: r["count"] for r in crawl_store.read_crawl(spark, at).groupBy("crawl_id").count().collect()} == {"c0": 20_000, "c1": 100, "c2": 20_000}


def test_page_sets_scan_once(spark, tmp_path):
    """One scan and one shuffle for all sets; pages without a directory and of several kinds."""
    rows = [(i, (200, 301, 404, 500, None)[i % 5], i % 4, ("INDEXABLE", "NOINDEX")[i % 2], (None, "/", "/a")[i % 3], ("HTML_PAGE", None, "IMAGE")[i % 3], ("HTML_PAGE", "IMAGE")[i % 2], i % 7 == 0, i % 2 == 0, 100 * i, i, i % 3 or None) for i in range(50)]
    schema = "id long, status_code int, depth int, indexability_reason string, directory string, resource_type string, media_type string, mime_mismatch boolean, indexable boolean, response_time int, word_count int, cluster_id int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    sets = stats.page_sets(pages)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    got = {(r["section"], r["key"]): (r["n"], r["html"]) for r in sets.collect()}
    page = [r for r in rows if (r[5] or "HTML_PAGE") == "HTML_PAGE"]
    assert got["totals", None] == (50, len(page))
    assert {k: v[1] for (s, k), v in got.items() if s == "depth"} == {str(d): sum(r[2] == d for r in page) for d in range(4)}
    assert {k: v[0] for (s, k), v in got.items() if s == "directory"} == {d: sum(r[4] == d for r in rows) for d in (None, "/", "/a")}
    one = sets.where("section = 'totals'").first()
    plain = stats.totals(pages).first()
    assert all(one[c] == plain[c] for c in ("indexable", "errors_html", "errors_all", "redirects", "avg_depth", "avg_response_time", "avg_word_count"))
    assert stats.page_sets(pages.where("false")).where(F.col("n") > 0).count() == 0
