"""Connected components by pointer jumping, for nodes of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, discard


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the smallest node that it is connected with) of every node of some pairs; a pair of a node with itself makes it one.

    Each round a node points to the smallest of its neighbours, its other neighbours are handed to that one, and pointers skip one
    step. A round is a written table, and the one before it is deleted; rounds are logarithmic in the longest path.
    """
    every = pairs.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct()
    now = cut(every.withColumn("open", F.lit(True)), "component-pairs")
    while not now.where("open and x <> y").isEmpty():
        down = now.groupBy("x").agg(F.min("y").alias("to"))
        hop = down.join(down.select(F.col("x").alias("to"), F.col("to").alias("next")), "to", "left")
        skipped = hop.select("x", F.coalesce("next", "to").alias("y"), (F.col("next") < F.col("to")).alias("open"))
        handed = now.join(down, "x").where(F.col("y") != F.col("to")).select(F.greatest("y", "to").alias("x"), F.least("y", "to").alias("y"), F.lit(True).alias("open"))
        new = skipped.unionByName(handed).groupBy("x", "y").agg(F.max(F.coalesce("open", F.lit(False))).alias("open"))
        last, now = now, cut(new, "component-pairs")
        discard(last)
    below = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return below.unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
