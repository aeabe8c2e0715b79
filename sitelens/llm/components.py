"""Connected components of an edge table by pointer jumping, without collecting edges or gathering a node's edges in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) for each node of an edge; self-links and repeated edges are harmless.

    Each round points every node to its smallest neighbour, links that neighbour to the node's others, and lets the node skip to
    where its neighbour points. All three keep what is connected together; the pointers' paths halve. A round writes one table,
    and deletes the one before.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        lowest = now.groupBy("u").agg(F.min("v").alias("p"))
        above = lowest.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jumped = lowest.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("v"), F.col("pp").isNotNull().alias("moved"))
        beside = now.join(lowest, "u").where(F.col("v") != F.col("p")).select(F.greatest("v", "p").alias("u"), F.least("v", "p").alias("v"), F.lit(True).alias("moved"))
        last, now = now, cut(jumped.unionByName(beside).groupBy("u", "v").agg(F.max("moved").alias("moved")), "edges")
        discard(last)
        if now.where("moved").isEmpty():  # each node has one pointer, to a node that has none
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
