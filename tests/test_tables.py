"""Paged answers, tables in buckets and running budgets, with breaks in between."""

import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sitelens.operators import keywords, sinks
from sitelens.operators.bucket_table import BucketTable
from sitelens.sources import search_api

ROWS = "k long, g string, v string, at int"


def page(site, day, start, n, hour=1, tag=""):
    rows = [{"keys": [f"{site} query {start + i}", f"u{i}"], "clicks": float(start + i), "impressions": 1.0, "ctr": 0.1, "position": 2.0} for i in range(n)]
    return (site, date(2024, 1, day), start, datetime(2024, 2, 1, hour), json.dumps({"rows": rows} if n else {}) + tag)


@pytest.fixture
def recorded(spark, tmp_path):
    """Two days of one site, the second without its middle page; an empty day of another; a page fetched twice. Read by a path that only Spark knows."""
    at = tmp_path / "recorded"
    rows = [page("a", 1, 0, 10), page("a", 1, 10, 10), page("a", 1, 20, 4), page("a", 2, 0, 10), page("a", 2, 20, 3), page("b", 1, 0, 0), page("a", 1, 10, 9, hour=0)]
    for k, r in enumerate(rows):  # a file for each page
        spark.createDataFrame([r], search_api.PAGE).coalesce(1).write.mode("append").json(str(at))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.only.link./in", f"file://{at}")
    return "viewfs://only/in"


def test_pages_that_are_lacking(spark, recorded):
    pages = search_api.read_pages(spark, recorded)
    asked = spark.createDataFrame([("a", date(2024, 1, d)) for d in (1, 2, 3)] + [("b", date(2024, 1, 1))], "site string, date date")
    got = {(r["site"], r["date"].day): r["start_row"] for r in search_api.next_requests(asked, pages, page_rows=10).collect()}
    assert got == {("a", 2): 10, ("a", 3): 0}
    counts = {(r["site"], r["date"].day): (r["pages"], r["rows"], r["whole"]) for r in search_api.day_counts(pages, page_rows=10).collect()}
    assert counts == {("a", 1): (3, 24, True), ("a", 2): (2, 13, False), ("b", 1): (1, 0, True)}
    rows = search_api.page_rows_of(pages, ["query", "page"]).where("site = 'a' AND day(date) = 1").orderBy("input_order").collect()
    assert [(r["input_order"], r["query"], r["clicks"]) for r in rows] == [(i, f"a query {i}", float(i)) for i in range(24)]
    more = pages.unionByName(spark.createDataFrame([page("a", 2, 10, 10), page("a", 3, 0, 10)], search_api.PAGE))
    got = {(r["site"], r["date"].day): r["start_row"] for r in search_api.next_requests(asked, more, page_rows=10).collect()}
    assert got == {("a", 3): 10}


def test_stream_of_pages_after_a_break(spark, tmp_path, recorded):
    """A batch that is written but not logged as done comes again after the restart: no page is lost, none counts twice."""
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def fail(number):
        if number == 2:
            raise RuntimeError("lost the driver")

    stream = lambda: search_api.stream_pages(spark, recorded, files=2)
    q = search_api.write_pages(stream(), out, log, after=fail)
    with pytest.raises(Exception, match="lost the driver"):
        q.processAllAvailable()
    for _ in range(2):
        q = search_api.write_pages(stream(), out, log)
        q.processAllAvailable()
        q.stop()
    read = spark.read.parquet(out).drop("batch")
    want = sorted(tuple(r) for r in search_api.page_rows_of(search_api.read_pages(spark, recorded), ["query", "page"]).collect())
    assert sorted(tuple(r) for r in search_api.page_rows_of(read, ["query", "page"]).collect()) == want and len(want) == 37


def test_recorded_answers(spark, tmp_path):
    at = str(tmp_path / "x")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text('{"url": "u", "status": 200, "body": "b"}\n{"url": "v", "error_type": "TIMEOUT"}\n')
    assert [(r["url"], r["status"], r["error_type"]) for r in search_api.read_responses(spark, at).orderBy("url").collect()] == [("u", 200, None), ("v", None, "TIMEOUT")]
    body = {"keyword": "k", "cost": 0.005, "found": True, "rank_group": 3, "rank_absolute": 5, "url": "u", "total_results": 9, "items": [{"type": "organic", "rank_group": 1, "rank_absolute": 1, "domain": "d", "url": "x", "title": "t"}, {"type": "video"}, {"type": "video"}]}
    got = search_api.serp_checks(spark.createDataFrame([(json.dumps(body),)], "body string")).first()
    assert (got["found"], got["rank"], got["rank_url"], got["feature_types"], got["total_results"], got["cost_usd"]) == (True, 3, "u", "video", 9, 0.005)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("k", "g", "v", "at").collect())


def test_bucket_table(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    old = [(k, f"g{k % 3}", "old", 0) for k in range(300)]
    table = BucketTable.create(spark.createDataFrame(old, ROWS), str(tmp_path / "t"), ["k", "g"], buckets=16)
    assert rows_of(table.read()) == old and table.versions() == [0]
    new = [(k, f"g{k % 3}", f"new {n}", n) for k in (5, 7, 1000) for n in range(3)]
    incoming = spark.createDataFrame(new, ROWS)
    some = table.touched(incoming)
    want = rows_of(sinks.upserted(spark.createDataFrame(old, ROWS), incoming, ["k", "g"], F.col("at")))
    # A change that breaks off before its manifest leaves the table as it was.
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.upsert(spark.createDataFrame([(1, "g1", "half", 9)], ROWS), F.col("at"))
    assert rows_of(table.read()) == old and table.versions() == [0]
    assert table.upsert(incoming, F.col("at")) == 1
    assert rows_of(table.read()) == want and rows_of(table.read(0)) == old
    before, after = table._manifest(0)[1], table._manifest(1)[1]
    assert len(some) <= 3 and {b for b in after if after[b] != before.get(b)} == set(some)  # no other bucket is written
    files = table.find(k=7, g="g1").inputFiles()
    assert rows_of(table.find(k=7, g="g1")) == [(7, "g1", "new 2", 2)] and len({f.rsplit("/", 2)[-2] for f in files}) == 1
    assert rows_of(table.find(k=7, g="g0")) == []
    gone = spark.createDataFrame([(k, f"g{k % 3}") for k in range(0, 300, 3)], "k long, g string")
    assert table.delete(gone) == 2 and rows_of(table.read()) == [r for r in want if r[0] >= 300 or r[0] % 3]
    assert table.upsert(incoming.where("false"), F.col("at")) == 2
    table.vacuum()
    assert table.versions() == [2] and rows_of(table.read()) == [r for r in want if r[0] >= 300 or r[0] % 3]
    table.delete(table.read().select("k", "g"))
    assert rows_of(table.read()) == []
    table.upsert(spark.createDataFrame([(rng.randrange(9), "x", None, 1)], ROWS), F.col("at"))
    assert table.read().count() == 1
    with pytest.raises(ValueError, match="already"):
        BucketTable.create(incoming, str(tmp_path / "t"), ["k"])
    with pytest.raises(ValueError, match="keys are"):
        table.find(k=1)


def test_budget_in_many_ranges(spark):
    """Running costs over many ranges are those of a plain loop, for a large project, small ones and one without money."""
    rng = random.Random(8)
    rows = [(p, i * 37 % 5003, 0.005) for p, n in ((1, 4000), (2, 3), (3, 40)) for i in range(n)]
    rows += [(4, 1, 99.0), (4, 2, 0.0)]
    rng.shuffle(rows)
    want = set()
    for p in (1, 2, 3, 4):
        spent = 0.0
        for _, k, cost in sorted(r for r in rows if r[0] == p):
            spent += cost
            if round(spent, 9) <= 10.0:
                want.add((p, k))
    checks = spark.createDataFrame(rows, "project_id long, keyword_id long, cost_usd double").withColumn("__range", F.lit("clash"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = keywords.affordable(checks, 10.0)
        assert {(r["project_id"], r["keyword_id"]) for r in got.collect()} == want and "spent" in got.columns
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
