"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets are one class; the rest works on one
representative of each. A signature of minwise tokens places each representative in TREES independent trees: a node picks one
signature place at random, or two for every fourth root, and sends each document to the child of its token there; below the
roots every node that branches picks two, so that a pair at the threshold has 1.6 expected children in common and stays together
at every depth. Documents that meet in a node are candidates:

1. Nodes of at most LEAF documents are compared exhaustively, larger ones branch again. The comparison is of one byte for each
   signature place, with a bound that pairs at the threshold fail once in millions. It returns, of each node, the groups of
   documents that agree, not the pairs.
2. What is connected by such groups in all trees is compared exhaustively in one task, on the full sets, if it is small: so a text
   is sent once, however many trees it meets others in. An inverted file of the task's shingles counts the intersections; pairs
   that are connected already are skipped, and each document is returned with the smallest of its part.

Groups beyond one task (nodes still over LEAF after DEPTH levels, and groups that agree of more than BLOCK documents or WEIGHT
shingles) first meet LEADERS documents of their own, in blocks, and the links found name their parts. Links inside a part add
nothing, so that then only the documents outside the largest part meet all others of their node, in pairs of blocks. A large
group of near copies so costs a pass over its texts, and no link between parts is lost.

The links go to distributed connected components. No node, group of copies or hot key is gathered in one task.

Documents of fewer words than a shingle have their whole word sequence as the one element. Null texts, empty ones and such
without words have no set and link with nothing. Rows of the same doc_id are one document. Rows without doc_id link with nothing.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, discard, table, utf8_parts, whole_groups
from .components import connected_components
from .words import mix, parts, shingles, word_hashes

SHINGLE = 4
THRESHOLD = 80  # per cent
PLACES = 64
#: A pair at the threshold misses all trees with a probability under 1e-4, also where all nodes branch DEPTH times.
TREES = 8
LEAF = 4096
DEPTH = 6
#: Documents and shingles that are compared in one task.
BLOCK = 1024
WEIGHT = 1_000_000
LEADERS = 16
#: Signature places that must agree: five standard deviations below what a pair at the threshold has.
AGREE = 35
#: Bits of the filter for each candidate, and in all (16 MB).
FILTER_SHARE = 16
FILTER_BITS = 1 << 27
#: Roles in a comparison: each LEFT row meets each RIGHT one.
LEFT, RIGHT = 1, 2

_RANDOM = np.random.Generator(np.random.PCG64(77))
_XOR = _RANDOM.integers(0, 2**63, PLACES, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**62, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(x: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """PLACES minwise tokens (uint32) of each non-empty range of x."""
    starts = ranges[:-1][np.diff(ranges) > 0]
    out = np.empty((len(starts), PLACES), dtype=np.uint32)
    for k in range(PLACES if len(starts) else 0):
        out[:, k] = mix(np.minimum.reduceat((x ^ _XOR[k]) * _TIMES[k], starts)) >> np.uint64(32)
    return out


def branch(paths: np.ndarray, tokens: np.ndarray, root: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row and path of each child that rows (their node's path, their signature) go to: two, but of three in four roots one."""
    rows, children = [], []
    for turn in range(2):
        pick = mix(paths + np.uint64((2 * turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
        go = np.arange(len(paths)) if turn == 0 or not root else np.flatnonzero(pick >> np.uint64(62) == 0)
        place = (pick[go] % np.uint64(PLACES)).astype(np.int64)
        rows.append(go)
        children.append(mix(mix(paths[go] ^ (place.astype(np.uint64) + np.uint64(turn * 1000 + 17))) + tokens[go, place].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.concatenate(rows), np.concatenate(children)


def described(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null without), signature."""
    schema = "doc_id long, n_shingles long, h binary, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8_parts(batch.column(1))
            for a, b in parts(offsets):
                hashes, _, _, rows = word_hashes(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                x, ranges = shingles(hashes, rows, k)
                full = np.flatnonzero(np.diff(ranges) > 0)
                size, digest, sig = np.zeros(b - a, np.int64), [None] * (b - a), [None] * (b - a)
                for i, tokens in zip(full.tolist(), signatures(x, ranges), strict=True):
                    own = np.unique(x[ranges[i] : ranges[i + 1]])
                    size[i], digest[i], sig[i] = len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), tokens.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(size), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "h", "sig"])

    return docs.select(key, text).mapInArrow(run, schema)


def _tokens(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, PLACES)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, sig -> path, rep for the first level of all trees."""
    for batch in batches:
        tokens, reps = _tokens(batch.column(1)), np.asarray(batch.column(0))
        for tree in range(TREES):
            root = mix(np.full(1, tree + 1, dtype=np.uint64))
            rows, children = branch(np.repeat(root, len(reps)), tokens, root=True)
            yield pa.RecordBatch.from_arrays([pa.array(children.view(np.int64)), pa.array(reps[rows])], names=["path", "rep"])


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, rep, sig -> path, rep one level down."""
    for batch in batches:
        rows, children = branch(np.asarray(batch.column(0)).view(np.uint64), _tokens(batch.column(2)))
        yield pa.RecordBatch.from_arrays([pa.array(children.view(np.int64)), pa.array(np.asarray(batch.column(1))[rows])], names=["path", "rep"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, sig -> rep, few: a byte of each place."""
    for batch in batches:
        few = _tokens(batch.column(1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in few], pa.binary())], names=["rep", "few"])


def _groups_of(few: np.ndarray, reps: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each row the smallest row that it is connected with by agreement."""
    label = np.arange(len(few))
    left, right = np.flatnonzero(side & LEFT), np.flatnonzero(side & RIGHT)
    if len(few) <= 48:
        close = ((few[left][:, None, :] == few[right][None, :, :]).sum(axis=2) >= AGREE) & (reps[left][:, None] != reps[right][None, :])
        p, q = left[np.nonzero(close)[0]], right[np.nonzero(close)[1]]
        while len(p):
            low, before = np.minimum(label[p], label[q]), label.copy()
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
            if (label == before).all():
                break
        return label
    for p in left.tolist():
        q = right[(right > p) | (side[right] != LEFT | RIGHT)] if side[p] == LEFT | RIGHT else right
        q = q[(few[q] == few[p]).sum(axis=1) >= AGREE]
        q = q[reps[q] != reps[p]]
        old = np.unique(label[q])
        old = old[old != label[p]]
        if len(old):
            low = min(label[p], old[0])
            label[np.isin(label, np.append(old, label[p]))] = low
    return label


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """task, rep, side, few, sorted by task -> task, g, rep: the groups of two documents or more that agree; g is the smallest of each."""
    for rows, offsets in whole_groups(batches, ["task"]):
        task, reps, side = (rows.column(c).to_numpy() for c in ("task", "rep", "side"))
        few = np.frombuffer(b"".join(rows.column("few").to_pylist()), dtype=np.uint8).reshape(-1, PLACES)
        group = np.empty(len(task), dtype=np.int64)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            group[a:b] = a + _groups_of(few[a:b], reps[a:b], side[a:b])
        good = np.flatnonzero(np.bincount(group, minlength=len(group))[group] > 1)
        if len(good):
            first = np.full(len(group), np.iinfo(np.int64).max)
            np.minimum.at(first, group, reps)
            yield pa.RecordBatch.from_arrays([pa.array(task[good]), pa.array(first[group[good]]), pa.array(reps[good])], names=["task", "g", "rep"])


def _parts_of(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row the first row that pairs (of left and right) at the threshold connect it with."""
    above = list(range(len(sets)))

    def root(v: int) -> int:
        while above[v] != v:
            above[v] = above[above[v]]
            v = above[v]
        return v

    linked = False
    size = np.array([len(x) for x in sets])
    keys = np.concatenate([sets[q] for q in right.tolist()])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], np.repeat(right, size[right])[order]
    roots = np.arange(len(sets))
    for p in left.tolist():
        mine = root(p)
        if (roots[right] == mine).all():
            continue
        low, high = np.searchsorted(keys, sets[p], "left"), np.searchsorted(keys, sets[p], "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[at], minlength=len(sets))
        for q in np.flatnonzero((both > 0) & (100 * both >= THRESHOLD * (size[p] + size - both))).tolist():
            if q != p and (a := root(p)) != (b := root(q)):
                above[max(a, b)] = min(a, b)
                linked = True
        if linked:
            roots = np.array([root(v) for v in range(len(sets))])
    return roots


def _sets(column: pa.Array | pa.ChunkedArray, k: int) -> Iterator[np.ndarray]:
    offsets, data = utf8_parts(column)
    for a, b in parts(offsets):
        hashes, _, _, rows = word_hashes(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
        x, ranges = shingles(hashes, rows, k)
        for p, q in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
            yield np.unique(x[p:q])


def _comparison(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """task, rep, side, text, sorted by task -> a, b: what each task's links connect."""
        for rows, offsets in whole_groups(batches, ["task"]):
            reps, side, sets = rows.column("rep").to_numpy(), rows.column("side").to_numpy(), _sets(rows.column("text"), k)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = [next(sets) for _ in range(b - a)]
                left, right = np.flatnonzero(side[a:b] & LEFT), np.flatnonzero(side[a:b] & RIGHT)
                part = _parts_of(own, left, right) if len(left) and len(right) else np.zeros(0, np.int64)
                on = np.flatnonzero(np.bincount(part, minlength=len(part))[part] > 1)
                if len(on):
                    first = np.full(len(part), np.iinfo(np.int64).max)
                    np.minimum.at(first, part, reps[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(reps[a:b][on]), pa.array(first[part[on]])], names=["a", "b"])

    return run


def _blocks(n: str, w: str | None, block: int) -> Column:
    """Number of blocks for n documents with w shingles (if any are held)."""
    by_n = F.ceil(F.col(n) / block)
    return F.greatest(F.lit(1), by_n if w is None else F.greatest(by_n, F.ceil(F.col(w) / WEIGHT))).cast("int")


def _own(n: Column) -> Column:
    return F.pmod(F.xxhash64("rep"), n).cast("int")


def _led(rows: DataFrame) -> DataFrame:
    """Tasks (task, rep, side) in which each of rows (path, rep, n, w) meets LEADERS of its path."""
    first = W.Window.partitionBy("path").orderBy(F.xxhash64(F.lit("leader"), "rep"), "rep")
    leaders = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= LEADERS)
    task = F.xxhash64("path", "i").alias("task")
    blocks = _blocks("n", "w", BLOCK)
    return rows.withColumn("i", _own(blocks)).select(task, "rep", F.lit(RIGHT).alias("side")).unionByName(leaders.withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1))).select(task, "rep", F.lit(LEFT).alias("side")))


def _others(rows: DataFrame, labels: DataFrame, w: str | None, block: int) -> DataFrame:
    """Tasks in which those of rows (path, rep, w) outside the largest part of their path, by labels, meet all of the path."""
    known = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("path", "rep", "w", F.coalesce("component", "rep").alias("label"))
    parts = known.groupBy("path", "label").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    paths = parts.groupBy("path").agg(F.max(F.struct("n", "w", "label")).alias("top"), F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    paths = paths.select("path", F.col("top.label").alias("main"), "all_n", "all_w", (F.col("all_n") - F.col("top.n")).alias("less_n"), (F.col("all_w") - F.col("top.w")).alias("less_w")).where("less_n > 0")
    sized = known.join(paths, "path").withColumns({"bi": _blocks("less_n", w and "less_w", block), "bj": _blocks("all_n", w and "all_w", block)})
    task = F.xxhash64("path", "i", "j").alias("task")
    right = sized.withColumn("j", _own(F.col("bj"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bi") - 1))).select(task, "rep", F.lit(RIGHT).alias("side"))
    left = sized.where(F.col("label") != F.col("main")).withColumn("i", _own(F.col("bi"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("bj") - 1))).select(task, "rep", F.lit(LEFT).alias("side"))
    return right.unionByName(left)


class _Search:
    def __init__(self, docs: DataFrame, key: str, text: str, k: int, classes: DataFrame):
        self.texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
        self.k = k
        self.sigs, self.weights = classes.select("rep", "sig"), classes.select("rep", F.col("n_shingles").alias("w"))

    def nodes(self, rows: DataFrame) -> DataFrame:
        """Rows of nodes with two documents or more, with the node's size."""
        by = rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        return cut(rows.join(by, "path"), "node-rows")

    def leaves(self) -> list[DataFrame]:
        """path, rep, n of all nodes to be compared, those over LEAF too that are left after DEPTH levels."""
        rows = [self.nodes(self.sigs.mapInArrow(_roots, "path long, rep long"))]
        for _ in range(DEPTH):
            large = rows[-1].where(F.col("n") > LEAF)
            if large.isEmpty():
                break
            rows.append(self.nodes(large.join(self.sigs, "rep").select("path", "rep", "sig").mapInArrow(_children, "path long, rep long")))
        return rows

    def agreeing(self, tasks: DataFrame) -> DataFrame:
        """task, g, rep: groups whose signatures agree in the tasks."""
        few = self.sigs.mapInArrow(_short, "rep long, few binary")
        dealt = tasks.join(few, "rep").select("task", "rep", "side", "few").repartition("task").sortWithinPartitions("task")
        return cut(dealt.mapInArrow(_agreeing, "task long, g long, rep long"), "agreeing")

    def confirmed(self, tasks: DataFrame) -> DataFrame:
        """a, b: what links of the full texts connect in the tasks; a filter of bounded size keeps most other texts from being dealt out."""
        tasks = cut(tasks, "tasks")
        n = tasks.count()
        bits = min(FILTER_BITS, 1 << max(15, (FILTER_SHARE * n).bit_length()))
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
        filled = cut(tasks.select(slot("rep").alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits")), "bits")
        texts = self.texts.withColumn("s", slot("rep")).withColumn("bucket", F.expr("bitmap_bucket_number(s)")).withColumn("bit", F.expr("bitmap_bit_position(s)"))
        near = texts.join(F.broadcast(filled), "bucket")  # bits / 8 bytes at most
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        near = near.where(byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0).select("rep", "text")
        dealt = tasks.join(near, "rep").select("task", "rep", "side", "text").repartition("task").sortWithinPartitions("task")
        out = cut(dealt.mapInArrow(_comparison(self.k), "a long, b long"), "links")
        discard(tasks, filled)
        return out

    def run(self) -> DataFrame:
        """node and component of all that is linked."""
        both = F.lit(LEFT | RIGHT).alias("side")
        nodes = self.leaves()
        rows = reduce(DataFrame.unionByName, nodes)
        tasks, links = rows.where(F.col("n") <= LEAF).select(F.col("path").alias("task"), "rep", both), []
        huge = nodes[-1].where(F.col("n") > LEAF)
        if len(nodes) > DEPTH and not huge.isEmpty():
            huge = huge.join(self.weights, "rep")
            links.append(self.confirmed(_led(huge.join(huge.groupBy("path").agg(F.sum("w").alias("whole")), "path").select("path", "rep", "n", F.col("whole").alias("w")))))
            tasks = tasks.unionByName(_others(huge, connected_components(links[0]), None, LEAF))
        agree = self.agreeing(tasks)
        discard(*nodes)
        groups = connected_components(agree, "rep", "g")
        members = cut(groups.join(self.weights.withColumnRenamed("rep", "node"), "node").select(F.col("component").alias("path"), F.col("node").alias("rep"), "w"), "members")
        sized = members.drop("w").join(members.groupBy("path").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "path")
        fits = (F.col("n") <= BLOCK) & (F.col("w") <= WEIGHT)
        large = cut(sized.where(~fits), "large-groups")
        links.append(self.confirmed(sized.where(fits).select(F.col("path").alias("task"), "rep", both).unionByName(_led(large))))
        if not large.isEmpty():
            of_task = agree.join(large.select("rep", "w"), "rep").select(F.xxhash64("task", "g").alias("path"), "rep").distinct()
            of_task = cut(of_task.join(self.weights, "rep"), "task-groups")
            ids = F.sum(F.xxhash64("rep").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit("second"), "rep").cast("decimal(38,0)"))
            once = of_task.groupBy("path").agg(F.count("*").alias("n"), ids[0].alias("s1"), ids[1].alias("s2")).groupBy("n", "s1", "s2").agg(F.min("path").alias("path"))
            labels = connected_components(reduce(DataFrame.unionByName, links))
            more = self.confirmed(_others(of_task.join(once.select("path"), "path"), labels, "w", BLOCK))
            links = [labels.select(F.col("node").alias("a"), F.col("component").alias("b")), more]
            discard(of_task)
            if more.isEmpty():
                return labels
        discard(agree, members, large)
        return connected_components(reduce(DataFrame.unionByName, links))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept."""
    whole = cut(described(docs, key, text, shingle), "described")
    full = whole.where(F.col("h").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(full.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    every = cut(whole.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("h")).alias("h")), "documents")
    discard(whole)
    found = _Search(docs, key, text, shingle, classes).run()
    # Equal sets of one doc_id's several rows, too, make one component.
    of = classes.select("h", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h", F.coalesce("component", "rep").alias("component_id"))
    out = every.join(cut(of, "class-components"), "h", "left")
    discard(classes)
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
