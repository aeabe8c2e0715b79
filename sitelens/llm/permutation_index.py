"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its PREFIX nearest pivots in order. Rows are dealt by a hash into chunks; each chunk posts its rows
in inverted files by pivot (row, place in its order). A query adds up, over the files of its own pivots, how much a shared pivot
lowers Spearman's footrule between the two orders; the SHARE of each chunk with the smallest footrule, whatever the chunk's size,
is reranked by the exact Euclidean distance, and the chunks' best rows are merged. Every row is indexed and chunks are never cut.

Pivots are PIVOTS rows, those with the smallest hashes of their ids: a bounded sample. Recall against brute force is measured in
the tests, at the share of rows that production reranks.

Null, empty and zero vectors and such with null or non-finite components take no part, as rows or queries. Vectors of each length
are an index of their own, with own pivots: distances are between vectors of one length. Equal distances go to the smaller id.
Repeated rows are so many candidates; equal rows among the queries are one query, and vectors of one id that differ are so many
queries with results each. A query leaves out rows of its own id. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, table
from .vectors import as_matrix, packed, usable

PIVOTS = 512
PREFIX = 64
SHARE = 0.12
CHUNK_ROWS = 4096
QUERY_ROWS = 4096
RESULT = "query_id long, h long, vec_id long, score double"


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each row, nearest first; ties to the smaller pivot."""
    distance = (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.argsort(distance, axis=1, kind="stable")[:, :prefix].astype(np.uint16)


def search_chunk(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, pivots: np.ndarray, k: int, prefix: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, row ids and distances of each query's k best rows in a chunk."""
    own, asked = orders(x, pivots, prefix), orders(q, pivots, prefix)
    n, width = own.shape
    place = np.argsort(own.ravel(), kind="stable")  # the inverted files: rows by pivot
    file_rows, file_places = place // width, (place % width).astype(np.int32)
    ends = np.searchsorted(own.ravel()[place], np.arange(len(pivots) + 1))
    take = min(n, max(k, int(np.ceil(share * n))) + 1)  # one more for the query's own row
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        files = [slice(ends[p], ends[p + 1]) for p in asked[i].tolist()]
        gains = [width - np.maximum(file_places[f], np.int32(j)) for j, f in enumerate(files)]  # half of what a pivot takes off the footrule
        closeness = np.bincount(np.concatenate([file_rows[f] for f in files]), np.concatenate(gains), minlength=n)
        best = np.argpartition(-closeness, take - 1)[:take] if take < n else np.arange(n)
        best = best[ids[best] != qids[i]]
        distance = np.sqrt(((x[best] - q[i]) ** 2).sum(axis=1))
        first = np.lexsort((ids[best], distance))[:k]
        out.append((np.full(len(first), i), ids[best][first], distance[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def _of_length(rows: DataFrame, asked: DataFrame, d: int, n: int, n_queries: int, k: int, share: float, chunk_rows: int) -> DataFrame:
    """query_id, h, vec_id, score: the best rows of each chunk for each query; all vectors (id, e) have d components."""
    spark = rows.sparkSession
    sample = rows.select("e", F.xxhash64("id", "e").alias("h")).distinct().orderBy("h", "e").limit(PIVOTS).collect()
    shared = spark.sparkContext.broadcast(np.array([r["e"] for r in sample], dtype=np.float64))
    prefix = min(PREFIX, len(sample))
    chunks, parts = -(-n // chunk_rows), -(-n_queries // QUERY_ROWS)
    dealt = lambda m: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(m)).cast("int")
    # Rows are dealt by their place in a written table: a task that runs again finds them where they were.
    index = cut(packed(rows, "e", "v"), "vectors").withColumn("chunk", dealt(chunks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = cut(packed(asked, "e", "v"), "queries").withColumn("part", dealt(parts)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "h", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([*(pa.array([], pa.int64()) for _ in range(3)), pa.array([], pa.float64())], names=names)
        x, q, qids = as_matrix(left.column("v"), d), as_matrix(right.column("v"), d), right.column("id").to_numpy()
        asked_by, ids, scores = search_chunk(x, left.column("id").to_numpy(), q, qids, shared.value, k, prefix, share)
        return pa.table([pa.array(qids[asked_by]), pa.array(right.column("h").to_numpy()[asked_by]), pa.array(ids), pa.array(scores)], names=names)

    return index.groupBy("chunk", "part").cogroup(asked.groupBy("chunk", "part")).applyInArrow(search, RESULT)


def nearest(df: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, share: float = SHARE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of df for each row of queries."""

    def rows_of(frame: DataFrame) -> DataFrame:
        e = frame.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e"))
        return e.where(usable("e") & F.col("id").isNotNull())

    rows, asked = rows_of(df), rows_of(queries).distinct().withColumn("h", F.xxhash64("e"))
    lengths = rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"))
    with_queries = lengths.join(asked.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("asked")), "d").orderBy("d").collect()  # a row for each length
    found = [_of_length(rows.where(F.size("e") == d), asked.where(F.size("e") == d), d, n, m, k, share, chunk_rows) for d, n, m in with_queries]
    near = reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], RESULT)
    order = W.Window.partitionBy("query_id", "h").orderBy("score", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))
