"""Imports of keywords against a plain loop over their rows, on random rows."""

import random
from datetime import date

from pyspark.sql import functions as F

from sitelens.operators import keyword_import as ki
from sitelens.sources import keyword_csv

TODAY = date(2024, 3, 1)
ROW = "project_id string, n long, keyword string, position double, clicks double, impressions double, ctr double, url string, country string, device string, date date, tags string"


def table(spark, rows, schema):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)


def loop(rows, keywords, history):
    """The import a row at a time."""
    table, days = {k: dict(v) for k, v in keywords.items()}, dict(history)
    created = updated = skipped = 0
    for r in sorted(rows, key=lambda r: r["n"]):
        text = (r["keyword"] or "").strip()
        if not text or len(" ".join(text.lower().split())) > 255:
            skipped += 1
            continue
        text = text[:255]
        key = (r["project_id"], " ".join(text.lower().split()), {"es": "esp", "fr": "fra"}.get((r["country"] or "").strip().lower(), "esp"), {"MOBILE": "MOBILE"}.get((r["device"] or "").upper(), "ALL"))
        url, tags = (r["url"] or "").strip() or None, (r["tags"] or "").strip() or None
        day = r["date"] or TODAY
        count = lambda x: None if x is None else int(x + 0.5)
        k = table.get(key)
        if k is None:
            k = table[key] = dict.fromkeys(c.split()[0] for c in ki.KEYWORDS.split(", ")) | dict(zip(ki.KEYWORD_KEY, key, strict=True)) | {"source": "CSV", "tracked": True}
            created += 1
        else:
            updated += 1
            if r["position"] is not None:
                k["previous_position"] = k["last_position"]
        k["keyword"] = text
        for column, value in (("tags", tags), ("target_url", url), ("last_url", url), ("last_position", r["position"]), ("last_clicks", count(r["clicks"])), ("last_impressions", count(r["impressions"])), ("last_ctr", r["ctr"])):
            k[column] = value if value is not None else k[column]
        if r["position"] is not None:
            k["last_checked_at"] = day
            k["best_position"] = min(x for x in (r["position"], k["best_position"]) if x is not None)
        if any(r[c] is not None for c in ("position", "clicks", "impressions")):
            days[(*key, day)] = (r["position"], count(r["clicks"]) or 0, count(r["impressions"]) or 0, r["ctr"] or 0.0, url, "CSV")
    return table, days, {"source": "CSV", "total": len(rows), "created": created, "updated": updated, "skipped": skipped}


def made(rng, n):
    some = lambda f: f() if rng.random() < 0.6 else None
    texts = ["Red shoes", "  red   SHOES", "blue", "Ünï", "ünï", "", None, "   ", "x" * 256, "y" * 255]
    return [
        {
            "project_id": rng.choice("PQ"), "n": i * 7 % n, "keyword": rng.choice(texts), "position": some(lambda: float(rng.randint(1, 40))), "clicks": some(lambda: rng.randint(0, 90) / 2), "impressions": some(lambda: rng.randint(0, 900) / 4),
            "ctr": some(rng.random), "url": some(lambda: rng.choice(["", " /a ", "/b"])), "country": some(lambda: rng.choice(["ES", "fr", ""])), "device": some(lambda: rng.choice(["mobile", "x"])), "date": some(lambda: date(2024, 2, rng.randint(1, 4))), "tags": some(lambda: rng.choice(["t", " "])),
        }
        for i in range(n)
    ]


def test_import_rows(spark):
    rng = random.Random(5)
    for n in (1, 30, 250):
        first, second = made(rng, n), made(rng, n)
        keywords, history, want = {}, {}, None
        have, days = spark.createDataFrame([], ki.KEYWORDS), spark.createDataFrame([], ki.HISTORY)
        for rows in (first, second):
            keywords, history, want = loop(rows, keywords, history)
            got = ki.import_rows(table(spark, rows, ROW), have, days, F.lit(TODAY))
            assert got["counters"].first().asDict() == want
            have = spark.createDataFrame(got["keywords"].collect(), ki.KEYWORDS)
            days = spark.createDataFrame(got["history"].collect(), ki.HISTORY)
            assert {tuple(r[c] for c in ki.KEYWORD_KEY): r.asDict() for r in have.collect()} == keywords
            assert {tuple(r)[:5]: tuple(r)[5:] for r in days.collect()} == history
            assert have.count() == len(keywords) and days.count() == len(history)


def test_import_empty_and_extra_columns(spark):
    have = spark.createDataFrame([("P", "a", "esp", "ALL", "A", "MANUAL", False, "t", None, 3.0, None, 2.0, 1, 1, 0.1, "/u", None)], ki.KEYWORDS)
    days = spark.createDataFrame([], ki.HISTORY)
    got = ki.import_rows(spark.createDataFrame([], ROW), have, days, F.lit(TODAY))
    assert got["keywords"].collect() == have.collect() and not got["history"].collect() and got["counters"].first().asDict() == {"source": "CSV", "total": 0, "created": 0, "updated": 0, "skipped": 0}
    odd = table(spark, [dict.fromkeys(c.split()[0] for c in ROW.split(", ")) | {"project_id": "P", "n": 1, "keyword": "a", "position": 9.0}], ROW).withColumn("valid", F.lit("x")).withColumn("normalized", F.lit("y")).withColumn("end", F.lit(0))
    row = ki.import_rows(odd, have, days, F.lit(TODAY))["keywords"].first()
    assert (row["last_position"], row["previous_position"], row["best_position"], row["tags"], row["tracked"], row["source"]) == (9.0, 3.0, 2.0, "t", False, "MANUAL")


def test_import_of_a_file(spark, tmp_path):
    path = tmp_path / "k.csv"
    path.write_text("Consulta;Posición;Clics;Impresiones;Página\nuno;3,5;1,5;1.200;/a\n;2;1;1;/b\nUNO;2;;;\ndos;;;;/c\n")
    rows = keyword_csv.read_rows(spark, str(path)).withColumn("project_id", F.lit("P"))
    got = ki.import_rows(rows, spark.createDataFrame([], ki.KEYWORDS), spark.createDataFrame([], ki.HISTORY), F.lit(TODAY))
    assert got["counters"].first().asDict() == {"source": "CSV", "total": 4, "created": 2, "updated": 1, "skipped": 1}
    found = {r["normalized"]: (r["keyword"], r["last_position"], r["previous_position"], r["best_position"], r["last_clicks"], r["last_impressions"], r["target_url"]) for r in got["keywords"].collect()}
    assert found == {"uno": ("UNO", 2.0, 3.5, 2.0, 2, 1200, "/a"), "dos": ("dos", None, None, None, None, None, "/c")}
    assert [tuple(r)[4:] for r in got["history"].collect()] == [(TODAY, 2.0, 0, 0, 0.0, None, "CSV")]


def test_register_queries(spark):
    rows = spark.createDataFrame(
        [("A b", "/1", 1.5, 10.0, 0.1, 5.0, 0), ("a  B", "/2", 2.0, 30.0, 0.2, 4.0, 1), ("new", "/3", 1.0, 50.0, 0.3, 9.0, 2), ("few", "/4", 0.0, 0.0, 0.0, 1.0, 3), ("least", "/5", 0.0, 1.0, 0.0, 1.0, 4)],
        "query string, page string, clicks double, impressions double, ctr double, position double, input_order long",
    )
    have = spark.createDataFrame([("P", "a b", "esp", "ALL", "A B", "MANUAL", False, "t", "/own", 6.0, None, 3.0, 1, 1, 0.1, "/u", None), ("Q", "new", "esp", "ALL", "new", "CSV", True, None, None, 1.0, None, 1.0, 1, 1, 0.1, "/u", None)], ki.KEYWORDS)
    got = ki.register_queries(rows, have, "P", F.lit(TODAY), limit=2)
    assert got["counters"].first().asDict() == {"source": "GSC", "total": 5, "created": 1, "updated": 1, "skipped": 3}
    out = {(r["project_id"], r["normalized"]): r for r in got["keywords"].collect()}
    assert len(out) == 3 and out["Q", "new"]["last_position"] == 1.0
    r = out["P", "a b"]
    assert (r["keyword"], r["target_url"], r["last_position"], r["previous_position"], r["best_position"], r["last_clicks"], r["last_url"], r["source"], r["tracked"]) == ("A B", "/own", 4.0, 6.0, 3.0, 2, "/2", "MANUAL", False)
    r = out["P", "new"]
    assert (r["keyword"], r["target_url"], r["last_position"], r["previous_position"], r["best_position"], r["source"], r["tracked"], r["last_checked_at"]) == ("new", "/3", 9.0, None, 9.0, "GSC", True, TODAY)


def shuffled_rows(spark):
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_last_but_one_by_few_rows(spark):
    """A keyword with most rows, written in two ways: what is shuffled are its texts in each task, not its rows."""
    n = 40_000
    many = F.col("id") % 10 != 0
    rows = spark.range(0, n, 1, 4).select(
        F.lit("P").alias("project_id"), F.col("id").alias("n"), F.when(many, F.when(F.col("id") % 2 == 0, "Red  shoes").otherwise(" red SHOES")).otherwise("blue").alias("keyword"), F.when(F.col("id") % 4 != 3, (F.col("id") % 97 + 1).cast("double")).alias("position"),
        *(F.lit(None).cast("double").alias(c) for c in ("clicks", "impressions", "ctr")), F.lit(None).cast("string").alias("url"), F.lit("ES").alias("country"), F.lit("").alias("device"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("tags"),
    )
    want = {}
    for i in range(n):
        if i % 4 != 3:
            key = "blue" if i % 10 == 0 else "red shoes"
            want[key] = (i % 97 + 1, want.get(key, (None, None))[0])
    seen = set(shuffled_rows(spark))
    got = ki.import_rows(rows, spark.createDataFrame([], ki.KEYWORDS), spark.createDataFrame([], ki.HISTORY), F.lit(TODAY))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        assert {r["normalized"]: (r["last_position"], r["previous_position"]) for r in got["keywords"].collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(x for k, x in shuffled_rows(spark).items() if k not in seen) < 1000
    assert got["counters"].first().asDict() == {"source": "CSV", "total": n, "created": 2, "updated": n - 2, "skipped": 0}
