"""Embedding near-duplicates: sign codes of random hyperplanes in several tables, exact cosine, connected components.

Equal vectors are one class with a multiplicity. Each class goes to one bucket of every table, first with SIGNS further signs of
its vector only. A bucket of more than BLOCK rows is dealt into blocks, and each pair of blocks is compared in a task of its own,
so that no task holds a large bucket; buckets are never cut. Classes whose signs differ from another's in no more places than a
pair at the threshold does (but once in millions) are what is left of a pair of blocks; only these get their vectors.

Within such a pair of blocks the cosines of all pairs are exact (double precision); a pair counts in the first table where it
meets. Tasks return the number of links of each vector and a forest of what they found connected, not the pairs.

Bits for each code grow with the number of vectors (buckets of about BUCKET rows); the number of tables follows from the bits
so that a pair exactly at the threshold meets in some table with probability RECALL, others with more.

Null, empty and zero vectors and such with null or non-finite components link with nothing: no links, their own component.
Vectors of different length never link. Repeated rows count as so many vectors. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, table, whole_groups
from .components import connected_components
from .vectors import as_matrix, balanced, packed, usable

THRESHOLD = 0.9
RECALL = 0.995
BUCKET = 256
BLOCK = 1024
SIGNS = 256
SEED = 20240607


def table_plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits and number of tables for n vectors."""
    bits = min(24, max(4, math.ceil(math.log2(max(n, 1) / BUCKET + 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def sign_codes(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """A code for each row of x and table."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def most_differing(threshold: float) -> int:
    """Places of SIGNS in which a pair at the threshold differs at most, five standard deviations above the mean."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SIGNS * p + 5 * math.sqrt(SIGNS * p * (1 - p)))


def sign_bytes(x: np.ndarray, seed: int = SEED + 1) -> np.ndarray:
    """SIGNS signs of each row as bytes."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], SIGNS))
    return np.packbits(x @ planes > 0, axis=1)


def _near(signs: np.ndarray, block: np.ndarray, i: int, j: int, most: int) -> np.ndarray:
    """Which rows differ from another, of the other block, in at most so many signs."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    words = signs.view(np.uint64)
    good = np.zeros(len(signs), dtype=bool)
    for a in range(0, len(left), 64):
        p = left[a : a + 64]
        differ = np.bitwise_count(words[p][:, None, :] ^ words[right][None, :, :]).sum(axis=2, dtype=np.int64)
        differ[p[:, None] == right[None, :]] = SIGNS
        close = differ <= most
        good[p] |= close.any(axis=1)
        good[right] |= close.any(axis=0)
    return good


def _compare(ids: np.ndarray, times: np.ndarray, x: np.ndarray, codes: np.ndarray, block: np.ndarray, t: int, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with links, their number, and the smallest id that each is connected with here."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    cosine = (x[left] @ x[right].T) / norms[left][:, None] / norms[right][None, :]
    p, q = np.nonzero(cosine >= threshold)
    p, q = left[p], right[q]
    new = p < q if i == j else np.ones(len(p), dtype=bool)
    p, q = p[new], q[new]
    if t:
        new = ~(codes[p, :t] == codes[q, :t]).any(axis=1)
        p, q = p[new], q[new]
    n = len(ids)
    links = np.bincount(p, times[q], minlength=n) + np.bincount(q, times[p], minlength=n)
    label = ids.copy()
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        if (new == label).all():
            break
        label = new
    on = np.flatnonzero(links)
    return ids[on], links[on].astype(np.int64), label[on]


GROUP = ["t", "code", "dim", "i", "j"]


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def links(classes: DataFrame, bits: int, tables: int, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """rep, n and low: partial counts of links and smallest ids connected, for classes (rep, times, v, dim)."""
    coded_schema = T.StructType([classes.schema["rep"], classes.schema["dim"], T.StructField("codes", T.BinaryType()), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("signs", T.BinaryType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                x = balanced(as_matrix(some.column(2), d))
                found = sign_codes(x, bits, tables)
                cells = pa.array([row.tobytes() for row in found], pa.binary())
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * tables, pa.int32()), pa.array(found.ravel(), pa.int32()))
                signs = pa.array([row.tobytes() for row in sign_bytes(x)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), cells, each, signs], names=[f.name for f in coded_schema])

    coded = cut(classes.select("rep", "dim", "v").mapInArrow(code, coded_schema), "codes")
    key = ["t", "code", "dim"]
    spread = coded.select("rep", "dim", "signs", F.posexplode("code").alias("t", "code"))
    large = cut(spread.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > block), "large-buckets")
    blocks = F.coalesce(F.ceil(F.col("rows") / block), F.lit(1)).cast("int")
    spread = spread.join(large, key, "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    # Pairs of blocks (i <= j) that hold the row's own block.
    with_other = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = with_other.select("rep", "signs", "own", *key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    most = most_differing(threshold)
    near_schema = T.StructType([T.StructField(c, T.LongType() if c == "rep" else T.IntegerType()) for c in (*GROUP, "own", "rep")])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets in whole_groups(batches, GROUP):
            own, i, j = (rows.column(c).to_numpy() for c in ("own", "i", "j"))
            signs = np.frombuffer(b"".join(rows.column("signs").to_pylist()), dtype=np.uint8).reshape(-1, SIGNS // 8)
            good = np.zeros(len(own), dtype=bool)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b - a > 1:
                    good[a:b] = _near(signs[a:b], own[a:b], i[a], j[a], most)
            if good.any():
                kept = rows.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([kept.column(f.name).combine_chunks().cast(pa.int64() if f.name == "rep" else pa.int32()) for f in near_schema], names=near_schema.names)

    near = cut(_dealt(tasks).mapInArrow(sift, near_schema), "near")
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("rep", "n", "low")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets in whole_groups(batches, GROUP):
            t, i, j, d, own, rep, times = (rows.column(c).to_numpy() for c in ("t", "i", "j", "dim", "own", "rep", "times"))
            found = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                some = rows.slice(a, b - a)
                x = balanced(as_matrix(some.column("v"), d[a]))
                codes = np.frombuffer(b"".join(some.column("codes").to_pylist()), dtype=np.int32).reshape(-1, tables)
                found.append(_compare(rep[a:b], times[a:b], x, codes, own[a:b], t[a], i[a], j[a], threshold))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=out.names)

    vectors = near.select("rep").distinct().join(classes.select("rep", "times", "v"), "rep").join(coded.select("rep", "codes"), "rep")
    found = cut(_dealt(near.join(vectors, "rep")).mapInArrow(compare, out), "links")
    discard(coded, large, near)
    return found


def dedup(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of df: its key as vec_id, n_links, component_id, kept."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e"))
    good = packed(rows.where(usable("e")), "e", "v")
    members = cut(good.withColumn("h", F.sha2("v", 256)), "vectors")
    classes = cut(members.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.first("v").alias("v")).where(F.col("rep").isNotNull()), "classes")
    bits, tables = table_plan(classes.count(), threshold)
    found = links(classes.select("rep", "times", "v", (F.length("v") / 8).cast("int").alias("dim")), bits, tables, threshold)
    of_class = connected_components(found.select("rep", "low"), "rep", "low")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = classes.select("h", "rep", "times").join(counts, "rep", "left").join(of_class.withColumnRenamed("node", "rep"), "rep", "left")
    known = cut(known.select("h", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "class-links")
    discard(found, classes)
    linked = members.select("id", "h").join(known, "h", "left").select("id", "n_links", "component_id")
    alone = rows.where(~usable("e")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone).select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))
