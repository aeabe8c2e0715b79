"""Streams replayed in several orders against the batch windows."""

import random
from datetime import datetime, timedelta

import pytest

from sitelens.operators import keywords
from sitelens.streaming import positions

SCHEMA = "keyword_id long, ts timestamp, position double"
DAY = datetime(2024, 1, 1)
COLUMNS = ["keyword_id", "ts", "position", "previous_position", "best_position"]


def run(spark, tmp_path, name, parts, lateness="3 days"):
    """What comes out when the parts arrive one after another; the stream is stopped and started again in between."""
    source, at = str(tmp_path / "in"), str(tmp_path / "state")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(source)
        out = positions.track_positions(spark.readStream.schema(SCHEMA).parquet(source), lateness=lateness)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", at).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*COLUMNS).collect())


def batch(spark, rows):
    history = spark.createDataFrame(rows, SCHEMA).selectExpr("keyword_id", "ts AS date", "position")
    return sorted((r["keyword_id"], r["date"], r["position"], r["previous_position"], r["best_position"]) for r in keywords.with_previous_and_best(history).collect())


@pytest.mark.parametrize("seed", range(2))
def test_any_order_within_the_lateness(spark, tmp_path, seed):
    """Measures that come up to three days late, in parts with restarts between them, give what the windows give."""
    rng = random.Random(seed)
    rows = [(k, DAY + timedelta(hours=7 * i + k, microseconds=rng.randrange(1000)), rng.choice([None, float(rng.randrange(1, 40))])) for k in range(3) for i in range(30)]
    arrive = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.randrange(60)))
    parts = [arrive[k : k + 30] for k in range(0, 90, 30)]
    end = [(99, DAY + timedelta(days=60), 1.0)]
    more = [(99, DAY + timedelta(days=61), 2.0)]  # the watermark moves on when a trigger is over
    got = run(spark, tmp_path, "any", [*parts, end, more])
    assert [r for r in got if r[0] != 99] == batch(spark, rows)


def test_later_than_the_lateness(spark, tmp_path):
    """A measure older than the watermark is dropped; those of the same millisecond stay in order; many batches of one key."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = [(1, DAY + timedelta(days=d), float(d * 7 % 11 + 1)) for d in range(24)] + [(1, DAY + timedelta(days=30, microseconds=m), float(m)) for m in (5, 3, 9)]
        late = [(1, DAY + timedelta(days=2, hours=1), 0.5)]
        got = run(spark, tmp_path, "late", [rows[:24], rows[24:], late, [(1, DAY + timedelta(days=90), 1.0)], [(1, DAY + timedelta(days=95), 1.0)]])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r for r in got if r[1] < DAY + timedelta(days=80)] == batch(spark, rows)
