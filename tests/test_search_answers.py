"""Recorded answers: rank histories, reference lists, and rows as JSON."""

import json
from datetime import date

from sitelens.operators import sinks
from sitelens.sources import search_api


def test_rank_history(spark):
    snap = lambda at, absolute, group, url="/u": {"captured_at": at, "rank_absolute": absolute, "rank_group": group, "url": url}
    body = json.dumps({"data": {"snapshots": [snap("2024-01-02T08:00:00Z", 9, 7), snap("2024-01-02T20:00:00Z", 5, None), snap("2024-01-03T00:00:00Z", None, None, None), snap(None, 1, 1), snap("2024-01-02T20:00:00Z", 6, 6)]}})
    answers = spark.createDataFrame([("k", "a.com", body), ("k", "a.com", body), ("none", "a.com", '{"data":{}}'), ("bad", "a.com", "<html>"), ("null", "a.com", None)], "keyword string, target string, body string")
    got = sorted((r["keyword"], r["date"], r["rank"], r["rank_url"]) for r in search_api.rank_history(answers).collect())
    assert got == [("k", date(2024, 1, 2), 5, "/u"), ("k", date(2024, 1, 3), None, None)]


def test_history_requests(spark):
    tracked = spark.createDataFrame([("a b&c", "a.com", 2724, "es", None), ("ñ", "b.com", None, "", "mobile")], "keyword string, target string, location_code int, language_code string, device string")
    assert sorted(r["request"] for r in search_api.history_requests(tracked, 5000).collect()) == ["keyword=%C3%B1&target=b.com&device=mobile&limit=1000", "keyword=a+b%26c&target=a.com&location_code=2724&language_code=es&limit=1000"]


def test_reference_rows(spark):
    one = lambda rows: json.dumps({"data": {"languages": rows}})
    answers = spark.createDataFrame([(1, one([{"code": "xx", "name": "old"}])), (3, None), (2, one([{"code": "es", "name": "Español"}, {"code": "es", "name": "Español"}, {"code": "en", "name": "English"}]))], "fetched_at int, body string")
    assert sorted(map(tuple, search_api.reference_rows(answers, "languages").collect())) == [("en", "English"), ("es", "Español")]
    assert search_api.reference_rows(answers, "locations").columns == ["code", "name", "country_iso_code"] and not search_api.reference_rows(answers, "locations").collect()


def test_as_json(spark):
    df = spark.sql("select 9007199254740993L as id, 1 as n, array(1L, null) as many, named_struct('a', 2L, 'b', 'x') as s, cast(null as struct<c:bigint>) as none, 'y' as `odd.name`")
    assert [json.loads(r["value"]) for r in sinks.as_json(df).collect()] == [{"id": "9007199254740993", "n": 1, "many": ["1", None], "s": {"a": "2", "b": "x"}, "none": None, "odd.name": "y"}]
