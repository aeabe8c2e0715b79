"""Keyword positions as a stream: previous and best position by key, daily results with a fixed lateness, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OUT = "keyword_id long, at long, position double, previous_position double, best_position double"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Positions(StatefulProcessor):
    """Holds a key's measures by millisecond until the watermark has passed them, then gives them out in order of time.

    A timer for each millisecond with a measure fires when no earlier one can come any more; a key's timers fire in order. So the
    previous and the best position are right whatever the order of arrival, and a step has the measures of one millisecond of one
    key in memory. Times are microseconds since 1970 (at).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "at array<long>, position array<double>")
        self.known = handle.getValueState("known", "last double, best double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for ms, some in batch.groupby(-(-batch["at"] // 1000)):  # the first millisecond that isn't before it
                at, position = some["at"].tolist(), [None if pd.isna(p) else float(p) for p in some["position"]]
                if self.waiting.containsKey((int(ms),)):
                    held = self.waiting.getValue((int(ms),))
                    at, position = [*held[0], *at], [*held[1], *position]
                self.waiting.updateValue((int(ms),), (at, position))
                self.handle.registerTimer(int(ms))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        last, best = self.known.get() if self.known.exists() else (None, None)
        rows = []
        for at, position in sorted(zip(*self.waiting.getValue((ms,)), strict=True), key=lambda x: x[0]):
            best = min((p for p in (best, position) if p is not None), default=None)
            rows.append((key[0], at, position, last, best))
            last = last if position is None else position
        self.waiting.removeKey((ms,))
        self.known.update((last, best))
        yield pd.DataFrame(rows, columns=["keyword_id", "at", "position", "previous_position", "best_position"]).astype({"position": "float64", "previous_position": "float64", "best_position": "float64"})

    def close(self) -> None:
        pass


def track_positions(stream: DataFrame, *, lateness: str = "3 days") -> DataFrame:
    """stream of keyword_id, ts, position with the last position before (that isn't null) and the best so far, as the batch windows
    give them: measures come out when the lateness has passed, whatever their order, and those that are later still are dropped.

    Idle keys keep two numbers, so that their next measure has a previous one. State that expires by itself would need processing
    time, with which timers on event time don't go together.
    """
    conf = stream.sparkSession.conf
    if "RocksDB" not in conf.get(STATE_STORE, ""):
        conf.set(STATE_STORE, ROCKS)  # keyed state and timers need it
    marked = stream.select("keyword_id", "ts", F.unix_micros("ts").alias("at"), F.col("position").cast("double").alias("position")).withWatermark("ts", lateness)
    found = marked.groupBy("keyword_id").transformWithStateInPandas(statefulProcessor=Positions(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return found.select("keyword_id", F.timestamp_micros("at").alias("ts"), "position", "previous_position", "best_position")


def daily_best(stream: DataFrame, *, lateness: str = "3 days") -> DataFrame:
    """Best position by keyword and day; a day is final when it is past the lateness of the measures."""
    return stream.withWatermark("ts", lateness).groupBy("keyword_id", F.window("ts", "1 day").alias("day")).agg(F.min("position").alias("position"), F.count("*").alias("measures"))


def write_days(stream: DataFrame, path: str, checkpoint: str):
    """Start writing finished days; each micro-batch replaces its own folder, so that a repeated one adds nothing twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.select("keyword_id", F.to_date("day.start").alias("date"), "position", "measures").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").start()
