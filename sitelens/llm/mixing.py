"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents, in the order of a hash, form blocks. With weight w = a / A (a units of A in all), its k-th block (from
1) is released at slot floor((k - 1) / w) and due at slot ceil(k / w); each slot goes to the released block with the earliest
deadline, then the source with more units, then the first in the order of its name's hash. With weights that sum to 1 every
block meets its deadline, so that after any slot t a source that still has blocks has had more than w t - 1 and fewer than w t + 1
of them. The schedule repeats every A slots, as all have had exactly their units by then.

Sources with as many units as one another have the same releases and deadlines. So the k-th blocks of all of them are one batch,
and only batches are scheduled: a batch runs until it is done or another is released. That takes two steps for each batch at most; their
number is the sum of the different units, whatever the number of sources. The runs are spread over slots, ranks of sources and
blocks by joins, so that neither sources nor documents are gathered anywhere. Smoothed sizes are RESOLUTION units in all, or as many
more as the smallest source needs to have one of its own, so that no number of small sources takes from the targets of others.

Slots of a source that has run out stay empty: the others keep their shares of one another. No row is dropped or repeated; rows
of a source with weight 0 have no block, slot and position (nulls), sources without a given weight have one unit, and a negative
weight is an error. Ranks within a source come from counts by hash bucket, so that no task holds a source. A null source is a
source of its own, named ''. An empty table gives an empty result. Ties (equal ids) are placed next to each other in either order.
Columns of any name pass through; those named as one of the three results give way to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import cut, table

BLOCK_ROWS = 64
RESOLUTION = 1000
#: Hex digits of the hash that name a bucket within a source, or within the sources of as many units: 4096 buckets.
BUCKET_DIGITS = 3
EXPONENT = 0.5
#: Slots of a period that are sent to every task (a few MB); longer ones are joined by a shuffle.
BROADCAST_SLOTS = 50_000
RESULTS = ["__block", "__slot", "__position"]


def smoothed_units(sizes: DataFrame, exponent: float = EXPONENT, resolution: int = RESOLUTION) -> DataFrame:
    """Units of each source of sizes (source, n) in proportion to its number of rows to the power exponent: resolution in all, or more if the smallest source would have none."""
    size = sizes.groupBy("source").agg(F.pow(F.sum("n").cast("double"), F.lit(exponent)).alias("size"))
    total = size.agg(F.sum("size").alias("total"), F.min("size").alias("least"))
    share = F.greatest(F.lit(resolution), F.ceil(F.round(F.col("total") / F.col("least"), 6))) * F.col("size") / F.col("total")
    return size.join(F.broadcast(total)).select("source", F.floor(F.round(share, 6)).cast("long").alias("units"))  # total: one row


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def _before(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, bucket, n) with the sum of n over the group's buckets before."""
    before = W.Window.partitionBy(group).orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def batches(units: DataFrame) -> DataFrame:
    """units, turn, first, slot, length, period: runs of the period's schedule; in each, sources from the first-th on of those with so many units have their turn."""
    classes = units.groupBy("units").agg(F.count("*").alias("sources"))  # one for each number of units
    one = classes.agg(F.sort_array(F.collect_list(F.struct("units", "sources")), asc=False).alias("c"), F.sum(F.col("units") * F.col("sources")).alias("period"), F.sum("units").alias("batches")).where("period > 0")
    c, period, never = F.col("c"), F.col("period"), F.lit(2**62)

    def release(turn: Column, i: Column) -> Column:
        return F.when(turn < c[i]["units"], F.floor(turn * period / c[i]["units"])).otherwise(never)

    def step(state: Column, _: Column) -> Column:
        ready = F.transform(state["turn"], lambda k, i: F.when(release(k, i) <= state["slot"], F.struct(F.ceil((k + 1) * period / c[i]["units"]).alias("due"), i.alias("i"))))
        later = F.array_min(F.transform(state["turn"], lambda k, i: F.when(release(k, i) > state["slot"], release(k, i))))

        def run(best: Column) -> Column:
            i, left = best["i"], c[best["i"]]["sources"] - F.element_at(state["done"], best["i"] + 1)
            return _let(F.least(left, F.coalesce(later, never) - state["slot"]).cast("long"), lambda n: moved(i, n, n == left))

        def moved(i: Column, n: Column, over: Column) -> Column:
            took = F.struct(i.alias("i"), F.element_at(state["turn"], i + 1).alias("turn"), F.element_at(state["done"], i + 1).alias("first"), state["slot"].alias("slot"), n.alias("length"))
            return F.struct(
                (state["slot"] + n).alias("slot"),
                F.transform(state["turn"], lambda k, j: F.when((j == i) & over, k + 1).otherwise(k)).alias("turn"),
                F.transform(state["done"], lambda x, j: F.when(j == i, F.when(over, F.lit(0).cast("long")).otherwise(x + n)).otherwise(x)).alias("done"),
                F.array_append(state["runs"], took).alias("runs"),
            )

        return F.when(state["slot"] < period, _let(F.array_min(ready), run)).otherwise(state)

    none = F.transform("c", lambda x: F.lit(0).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("slot"), none.alias("turn"), none.alias("done"), F.array().cast("array<struct<i:int,turn:bigint,first:bigint,slot:bigint,length:bigint>>").alias("runs"))
    runs = F.aggregate(F.sequence(F.lit(1).cast("long"), 2 * F.col("batches")), start, step, lambda x: x["runs"])
    each = one.select("c", "period", F.explode(runs).alias("r"))
    return each.select(F.element_at("c", F.col("r.i") + 1)["units"].alias("units"), "r.turn", "r.first", "r.slot", "r.length", "period")


def period(units: DataFrame) -> DataFrame:
    """One period of the schedule for units (source, units): source, turn (from 0), in_period (slot), period (slots)."""
    named = units.where("units > 0").withColumn("hash", F.md5(F.col("source").cast("binary"))).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    offsets = _before(named.groupBy("units", "bucket").agg(F.count("*").alias("n")), "units").select("units", "bucket", "offset")
    within = W.Window.partitionBy("units", "bucket").orderBy("hash", "source")
    ranked = named.withColumn("place", F.row_number().over(within) - 1).join(offsets, ["units", "bucket"]).select("source", "units", (F.col("place") + F.col("offset")).alias("place"))
    slots = batches(units.where("units > 0")).select("units", "turn", "period", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)).alias("k", "place"), "slot")
    slots = slots.select("units", "turn", "place", (F.col("slot") + F.col("k")).alias("in_period"), "period")
    turns = ranked.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
    return turns.join(slots, ["units", "turn", "place"]).select("source", "turn", "in_period", "period")


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, *, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with __block (of its source, from 0), __slot and __position; weights: units by source, or None to smooth the sizes."""
    spark = docs.sparkSession
    named = F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("hash")
    bucket = F.substring("hash", 1, BUCKET_DIGITS).alias("bucket")
    keep = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(named, hashed, F.col(key).alias("key"), F.struct(*keep).alias("row")).select("*", bucket)
    sizes = cut(docs.select(named, hashed).select("source", bucket).groupBy("source", "bucket").agg(F.count("*").alias("n")), "source-sizes")
    if weights is None:
        units = smoothed_units(sizes)
    else:
        if any(v < 0 for v in weights.values()):
            raise ValueError("weights can't be negative")
        schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("units", T.LongType())])
        given = spark.createDataFrame([(str(k), int(v)) for k, v in weights.items()], schema)
        units = sizes.select("source").distinct().join(given, "source", "left").select("source", F.coalesce("units", F.lit(1).cast("long")).alias("units"))
    units = cut(units, "source-units")
    plan = cut(period(units), "period")
    slots = plan.limit(BROADCAST_SLOTS + 1).count()
    offsets = _before(sizes, "source").join(units, "source").select("source", "bucket", "offset", F.col("units").alias("of"))
    within = W.Window.partitionBy("source", "bucket").orderBy("hash", "key")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["source", "bucket"])
    ranked = ranked.withColumn("at", F.col("rank") + F.col("offset")).withColumn("block", F.when(F.col("of") > 0, F.floor(F.col("at") / block_rows))).withColumn("turn", F.col("block") % F.col("of"))
    placed = ranked.join(F.broadcast(plan) if slots <= BROADCAST_SLOTS else plan, ["source", "turn"], "left")
    slot = F.floor(F.col("block") / F.col("of")) * F.col("period") + F.col("in_period")
    return placed.select("row.*", F.col("block").alias("__block"), slot.alias("__slot"), (slot * block_rows + F.col("at") % block_rows).alias("__position"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return schedule(docs).select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))


OP8_SQL = f"""
WITH RECURSIVE n AS (
  SELECT coalesce(source, '') AS s, count(*) AS c FROM documents GROUP BY 1
), u AS (
  SELECT s, CAST(floor(round(greatest({RESOLUTION}, ceil(round(total / least, 6))) * pow(c, {EXPONENT}) / total, 6)) AS BIGINT) AS a FROM n, (SELECT sum(pow(c, {EXPONENT})) AS total, min(pow(c, {EXPONENT})) AS least FROM n)
), g AS (
  SELECT list(a ORDER BY a DESC, md5(s), s) AS a, list(s ORDER BY a DESC, md5(s), s) AS s, CAST(sum(a) AS BIGINT) AS total FROM u
), e(slot, turn, best, took) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM g
  UNION ALL
  SELECT slot + 1, list_transform(turn, lambda k, i: CASE WHEN i = b.i THEN k + 1 ELSE k END), b.i, turn[b.i]
  FROM (
    SELECT e.slot, e.turn, g.total, list_min(list_filter(list_transform(e.turn, lambda k, i: CASE WHEN k * g.total // g.a[i] <= e.slot + 1
      THEN {{'due': ((k + 1) * g.total + g.a[i] - 1) // g.a[i], 'i': CAST(i AS BIGINT)}} END), lambda x: x IS NOT NULL)) AS b
    FROM e, g WHERE e.slot + 1 < g.total
  )
), p AS (
  SELECT g.s[best] AS s, took, slot, g.a[best] AS a, g.total FROM e, g WHERE slot >= 0
), r AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place
  FROM documents
)
SELECT r.doc_id, r.source, place // {BLOCK_ROWS} AS block, (place // {BLOCK_ROWS}) // a * total + slot AS slot,
  ((place // {BLOCK_ROWS}) // a * total + slot) * {BLOCK_ROWS} + place % {BLOCK_ROWS} AS position
FROM r JOIN u USING (s) JOIN p USING (s, a) WHERE p.took = (place // {BLOCK_ROWS}) % u.a
"""
