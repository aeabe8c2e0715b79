"""Link-graph metrics: PageRank, HITS, betweenness, communities, and their wiring to pages."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.components import components
from ..functions.lineage import cut, discard
from .links import edges_within

#: Bytes that a task of betweenness may take; crawls whose links and paths from eight sources take more are searched by joins.
TASK_BYTES = 512 << 20
#: Sources of a block of such a task; about as many, as they are dealt by hash.
TASK_SOURCES = 1024
#: Links in a row of those that each block gets; about as many.
PACKED = 4096
#: Bits of words that are looked through at once.
BITS = 1 << 18
#: Blocks of betweenness tasks above which several share a task.
TASKS = 2000
#: Pairs (source, node) of one batch of betweenness sources that are searched by joins, 10 bytes each.
STATE_ROWS = 120_000_000
#: Sources of such a batch whose paths to a node are one row; about as many, as they are dealt by hash (places have two bytes).
BLOCK = 2048
#: Links of a node above which what they carry is summed before it is shuffled as well.
HUB = 2000
#: Linked nodes of a block of HITS, whose scores are one array; about as many, as they are dealt by hash.
HITS_BLOCK = 32_768
#: What blocks of HITS are sent, int32 places and float64 scores as bytes; of a cell the places here and those in the other block.
_PARTS = "block int, other int, places binary, data binary"
#: Crawls whose totals (two numbers each) are sent to every task.
BROADCAST_CRAWLS = 100_000


def _with_crawl(nodes: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """id and crawl (crawl_id, or one crawl for all) of nodes, and what a small enough table of one row for each crawl is joined as."""
    keyed = nodes.select("id", (F.col("crawl_id") if "crawl_id" in nodes.columns else F.lit(0)).alias("crawl"))
    few = keyed.select("crawl").distinct().limit(BROADCAST_CRAWLS + 1).count() <= BROADCAST_CRAWLS
    return keyed, F.broadcast if few else (lambda df: df)


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, iterations: int = 30, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """id, rank. Parallel edges count, self-links don't, dangling mass is spread evenly. Each crawl_id of nodes is a graph of its own.

    Edges are summed up by pair and weighted once; each round is one join and one partially aggregated sum, and is written, as
    the next one reads it in three places. The L1 change is checked every few rounds, so up to every - 1 rounds more than needed
    may run; several crawls go on until the last of them is done.
    """
    keyed, small = _with_crawl(nodes)
    pairs = edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    degree = cut(pairs.groupBy("src").agg(F.sum("w").alias("degree")), "degrees")
    share = cut(pairs.join(degree, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("share")), "shares")
    sizes = cut(keyed.groupBy("crawl").agg(F.count("*").cast("double").alias("n")), "sizes")
    flags = keyed.join(small(sizes), "crawl").join(degree.select(F.col("src").alias("id"), F.lit(True).alias("out")), "id", "left")
    ranks = cut(flags.select("id", "crawl", "n", F.col("out").isNull().alias("dangling"), (1 / F.col("n")).alias("rank")), "ranks")
    for k in range(1, iterations + 1):
        got = share.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = ranks.groupBy("crawl").agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        joined = ranks.select("id", "crawl", "n", "dangling", F.col("rank").alias("before")).join(got, "id", "left").join(small(lost), "crawl")
        rank = (1 - damping) / F.col("n") + damping * (F.col("lost") / F.col("n") + F.coalesce("got", F.lit(0.0)))
        last, ranks = ranks, cut(joined.select("id", "crawl", "n", "dangling", rank.alias("rank"), "before"), "ranks")
        discard(last)
        if k % every == 0 or k == iterations:
            change = ranks.groupBy("crawl").agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("change")).agg(F.max("change")).first()[0]
            if change is None or change < tolerance:
                break
    return ranks.select("id", "rank")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct directed edges without self-links."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def hits(nodes: DataFrame, edges: DataFrame, *, iterations: int = 100, tolerance: float = 1e-8, every: int = 5, block: int = HITS_BLOCK) -> DataFrame:
    """id, hub, authority; each sums to 1 in each crawl_id of nodes. Without edges all are 0.

    Linked nodes are dealt to blocks by hash and have a place there; the links from one block to another are one row, a cell. Half
    a round is one shuffle of few rows: a block's scores come before its cells, and each cell gives its sums to the block at its
    other end. Every few rounds the scores are rows of nodes again, scaled, written and compared with those before.
    """
    keyed, small = _with_crawl(nodes)
    simple = simple_edges(edges).join(keyed.select(F.col("id").alias("src")), "src", "left_semi").join(keyed.select(F.col("id").alias("dst")), "dst", "left_semi")
    simple = cut(simple, "simple-edges")
    linked = simple.select(F.col("src").alias("id"), F.lit(True).alias("out")).unionByName(simple.select(F.col("dst").alias("id"), F.lit(False).alias("out"))).groupBy("id").agg(F.max("out").alias("out"))
    linked = cut(linked.join(keyed, "id"), "linked")
    blocks = max(1, math.ceil(linked.count() / block))
    place = F.row_number().over(W.Window.partitionBy("block").orderBy("id")) - 1
    own = cut(linked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("place", place.cast("int")), "hits-nodes")
    width = (own.agg(F.max("place")).first()[0] or 0) + 1
    both = simple
    for end in ("src", "dst"):
        both = both.join(own.select(F.col("id").alias(end), F.col("block").alias(f"{end}_block"), F.col("place").alias(f"{end}_place")), end)
    both = cut(both.drop("src", "dst"), "hits-edges")

    def cells(a: str, b: str) -> DataFrame:
        ends = both.select(F.col(f"{a}_block").alias("block"), F.col(f"{b}_block").alias("other"), F.col(f"{a}_place").alias("place"), F.col(f"{b}_place").alias("to"))
        return cut(ends.groupBy("block", "other").applyInArrow(_cell, _PARTS), "hits-cells")

    forward, backward = cells("src", "dst"), cells("dst", "src")

    def dealt(parts: DataFrame) -> DataFrame:
        return parts.repartitionById(blocks, "block").sortWithinPartitions("block", "other")

    def authorities(parts: DataFrame) -> DataFrame:
        return dealt(parts.unionByName(forward)).mapInArrow(_spread(width), _PARTS)

    def rows(parts: DataFrame, c: str) -> DataFrame:
        return own.drop("out").join(dealt(parts).mapInArrow(_unpacked(width), f"block int, place int, {c} double"), ["block", "place"])

    def scaled(df: DataFrame, c: str) -> DataFrame:
        total = df.groupBy("crawl").agg(F.sum(c).alias("total"))
        return df.join(small(total), "crawl").select("id", "block", "place", (F.col(c) / F.col("total")).alias(c))

    def packed(hubs: DataFrame) -> DataFrame:
        return hubs.select("block", "place", "hub").mapInArrow(_packed, _PARTS)

    raw = cut(own.where("out").drop("out").withColumn("hub", F.lit(1.0)), "hubs")
    before = hubs = scaled(raw, "hub")
    parts = packed(hubs)
    for k in range(1, iterations + 1):
        parts = dealt(authorities(parts).unionByName(backward)).mapInArrow(_spread(width), _PARTS)
        if k % every == 0 or k == iterations:  # scaled only now and then: only the proportions matter
            last, raw = raw, cut(rows(parts, "hub"), "hubs")
            hubs = scaled(raw, "hub")
            change = hubs.join(before.select("id", F.col("hub").alias("old")), "id").agg(F.max(F.abs(F.col("hub") - F.col("old")))).first()[0]
            discard(last)
            before, parts = hubs, packed(hubs)
            if change is None or change < tolerance:
                break
    found = scaled(rows(authorities(parts), "authority"), "authority").select("id", "authority")
    return nodes.select("id").join(hubs.select("id", "hub"), "id", "left").join(found, "id", "left").fillna(0.0, ["hub", "authority"])


def _part(block: list[int], other: list[int], places: list[bytes], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(other, pa.int32()), pa.array(places, pa.binary()), pa.array(data, pa.binary())], ["block", "other", "places", "data"])


def _cell(edges: pa.Table) -> pa.Table:
    """The links from a block to another as one row: their places here and there, by those there."""
    place, to = (edges[c].to_numpy().astype(np.int32) for c in ("place", "to"))
    by = np.lexsort((place, to))
    return pa.Table.from_batches([_part([edges["block"][0].as_py()], [edges["other"][0].as_py()], [place[by].tobytes()], [to[by].tobytes()])])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows block, place and score as a part for each block, whose other block is -1."""
    for batch in batches:
        block, place, score = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        by = np.argsort(block, kind="stable")
        found, first = np.unique(block[by], return_index=True)
        groups = np.split(by, first[1:]) if len(found) else []
        yield _part(found.tolist(), [-1] * len(found), [place[g].astype(np.int32).tobytes() for g in groups], [score[g].astype(np.float64).tobytes() for g in groups])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """The rows of each batch, sorted by block and other block before."""
    for batch in batches:
        yield zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _spread(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the parts of a block, and makes of each of its cells a part for the other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, scores = None, np.zeros(width)
        for rows in _by_block(batches):
            out: tuple[list, list, list, list] = [], [], [], []
            for block, other, places, data in rows:
                if block != at:
                    at, scores = block, np.zeros(width)
                here = np.frombuffer(places, np.int32)
                if other < 0:
                    scores[here] += np.frombuffer(data, np.float64)
                    continue
                to = np.frombuffer(data, np.int32)
                first = np.flatnonzero(np.diff(to, prepend=-1))
                for column, x in zip(out, (other, -1, to[first].tobytes(), np.add.reduceat(scores[here], first).tobytes()), strict=True):
                    column.append(x)
            yield _part(*out)

    return run


def _unpacked(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the parts of each block to rows block, place and score of the places that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, scores, known = None, np.zeros(width), np.zeros(width, bool)

        def done() -> Iterator[pa.RecordBatch]:
            place = np.flatnonzero(known).astype(np.int32)
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), at, np.int32)), pa.array(place), pa.array(scores[place])], ["block", "place", "score"])

        for rows in _by_block(batches):
            for block, _, places, data in rows:
                if block != at:
                    yield from done()
                    at, scores, known = block, np.zeros(width), np.zeros(width, bool)
                here = np.frombuffer(places, np.int32)
                scores[here] += np.frombuffer(data, np.float64)
                known[here] = True
        yield from done()

    return run


def sources_for(n: int, error: float, confidence: float = 0.95) -> int:
    """Sources that hold the error of every node's sampled betweenness under error with this confidence (Hoeffding's bound, summed over n nodes)."""
    if n < 3:
        return n
    spread = n / (n - 1)  # a source adds this much at most to its mean
    return min(n, math.ceil(spread * spread * math.log(2 * n / (1 - confidence)) / (2 * error * error)))


def betweenness(nodes: DataFrame, edges: DataFrame, *, error: float | None = None, confidence: float = 0.95, state_rows: int = STATE_ROWS) -> DataFrame:
    """id, betweenness (directed, divided by (n - 1)(n - 2)); each crawl_id of nodes is a graph of its own.

    Sources are dealt to blocks, and a task searches the shortest paths from a block's sources through its crawl's links, as many
    sources at once as TASK_BYTES allows. What it returns is a row for each node, so that only links and sums are shuffled.
    Of crawls that take more than that, levels are joins, as _dependencies() says, in batches of state_rows pairs of source and node
    at most. The result is the same, and exact, as all nodes are sources, unless an error is given: then as
    many as sources_for() says, those with the smallest hashes of their ids, scaled up.
    """
    keyed, small = _with_crawl(nodes)
    own = cut(keyed.distinct(), "between-nodes")
    simple = simple_edges(edges).join(own.select(F.col("id").alias("src"), "crawl"), "src").join(own.select(F.col("id").alias("dst"), F.col("crawl").alias("other")), "dst")
    simple = cut(simple.where("crawl = other").select("crawl", "src", "dst"), "between-edges")
    sizes = own.groupBy("crawl").agg(F.count("*").alias("n")).join(simple.groupBy("crawl").agg(F.count("*").alias("links")), "crawl", "left").fillna(0, ["links"])
    if error is None:
        wanted = F.col("n")
    else:  # as sources_for(), for each crawl's n
        bound = F.pow(F.col("n") / F.greatest(F.col("n") - 1, F.lit(1)), 2) * F.log(2 * F.col("n") / (1 - confidence)) / (2 * error * error)
        wanted = F.when(F.col("n") < 3, F.col("n")).otherwise(F.least(F.col("n"), F.ceil(bound)))
    scale = F.when(F.col("n") > 2, F.col("n") / F.col("wanted") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    # Numbers of paths and dependencies of each source and node, ids and places of links, places of paths' links.
    lanes = F.coalesce(*(F.when(F.col("n") * 24 * k + F.col("links") * (64 + 8 * k) <= TASK_BYTES, k) for k in (64, 32, 16, 8)))
    sizes = cut(sizes.withColumn("wanted", wanted).select("crawl", "wanted", "n", "links", scale.alias("scale"), lanes.alias("lanes")), "between-sizes")
    linked = own.join(simple.select(F.col("src").alias("id")).distinct(), "id", "left_semi")  # others reach nothing
    chosen = linked if error is None else _smallest_hashes(own, sizes).join(linked.select("id"), "id", "left_semi")
    chosen = cut(chosen.select(F.col("id").alias("s"), "crawl"), "between-sources")
    shares = [_searched(chosen, simple, sizes.where("lanes is not null"), small)]
    far = sizes.where("lanes is null").select("crawl", "n")
    # Batches: a source's pairs are as many as its crawl has nodes.
    load = chosen.join(small(far), "crawl").agg(F.sum(F.col("n").cast("double")).alias("pairs"), F.count("*").alias("sources")).first()
    if load["sources"]:
        shares += _joined(chosen.join(small(far.select("crawl")), "crawl", "left_semi"), simple.join(small(far.select("crawl")), "crawl", "left_semi").drop("crawl"), load, state_rows)
    total = reduce(DataFrame.unionByName, shares).groupBy("id").agg(F.sum("c").alias("c"))
    out = own.join(sizes, "crawl").join(total, "id", "left")
    return out.select("id", (F.coalesce("c", F.lit(0.0)) * F.col("scale")).alias("betweenness"))


def _searched(chosen: DataFrame, simple: DataFrame, sizes: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, c: summed dependencies of the shortest paths from the chosen sources (s, crawl) of crawls whose links a task can hold."""
    counts = chosen.groupBy("crawl").agg(F.ceil(F.count("*") / TASK_SOURCES).cast("int").alias("blocks")).join(sizes, "crawl")
    counts = cut(counts.select("crawl", "blocks", "lanes", F.ceil(F.col("links") / PACKED).alias("parts")), "between-blocks")
    tasks = max(1, min(counts.agg(F.sum("blocks")).first()[0] or 0, TASKS))
    none = F.lit(None).cast("array<bigint>")
    sources = chosen.join(small(counts), "crawl").withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    sources = sources.groupBy("crawl", "block", "lanes").agg(F.collect_list("s").alias("sources")).select("crawl", "block", "lanes", "sources", none.alias("src"), none.alias("dst"))
    # Dealt out by number, as small rows that grow by the blocks must not come together in few tasks.
    packed = simple.join(small(counts), "crawl").withColumn("part", F.pmod(F.xxhash64("src", "dst"), F.col("parts"))).repartition(tasks, "crawl", "part")
    packed = packed.groupBy("crawl", "part").agg(F.collect_list(F.struct("src", "dst")).alias("links")).select("crawl", F.col("links.src").alias("src"), F.col("links.dst").alias("dst"))
    packed = packed.join(small(counts), "crawl").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = sources.unionByName(packed.select("crawl", "block", "lanes", none.alias("sources"), "src", "dst"))
    task = F.pmod(F.pmod(F.xxhash64("crawl"), F.lit(tasks)) + F.col("block"), F.lit(tasks)).cast("int")
    dealt = rows.withColumn("task", task).repartitionById(tasks, "task").sortWithinPartitions("crawl", "block")
    found = dealt.select("crawl", "block", "lanes", "sources", "src", "dst").mapInArrow(_by_sources, "id long, c double")
    return cut(found.groupBy("id").agg(F.sum("c").alias("c")), "credit")


def _by_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows id and c of each block of sources, whose rows (its sources, and the links of its crawl in parts) come one after another."""
    rows = ((batch, i) for batch in batches for i in range(batch.num_rows))
    for _, block in groupby(rows, lambda at: (at[0]["crawl"][at[1]].as_py(), at[0]["block"][at[1]].as_py())):
        parts: dict[str, list[np.ndarray]] = {"sources": [], "src": [], "dst": []}
        for batch, i in block:
            lanes = batch["lanes"][i].as_py()
            for c, found in parts.items():
                if batch[c][i].is_valid:
                    found.append(batch[c][i].values.to_numpy())
        if not parts["sources"]:  # no source's hash falls into the block
            continue
        ids, ends = np.unique(np.concatenate([*parts["src"], *parts["dst"]]), return_inverse=True)
        src, dst = np.split(ends.astype(np.int32), 2)
        by = np.argsort(src, kind="stable")
        first, dst, sources = np.searchsorted(src[by], np.arange(len(ids) + 1)), dst[by], np.searchsorted(ids, np.sort(np.concatenate(parts["sources"])))
        total = sum(_credits(sources[k : k + lanes], first, dst, lanes) for k in range(0, len(sources), lanes))
        between = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[between]), pa.array(total[between])], ["id", "c"])


def _credits(sources: np.ndarray, first: np.ndarray, dst: np.ndarray, lanes: int) -> np.ndarray:
    """Summed dependencies of the shortest paths from some sources, lanes at most, on each node (Brandes' sums); a node's links go from its first to the next node's.

    A word has a bit for each source. A link is on shortest paths from those that reached its start at the last level and not its
    end before; each such bit is a pair of places in the tables of nodes and sources. The pairs are walked back for the dependencies.
    """
    n, k = len(first) - 1, len(sources)
    words = (np.uint64(1) << np.arange(k, dtype=np.uint64)).astype(f"u{lanes // 8}")
    seen, ahead = np.zeros((2, n), words.dtype)
    at, start = sources, sources * lanes + np.arange(k)
    seen[at] = words
    paths = np.zeros(n * lanes)
    paths[start] = 1
    levels = []
    while len(at):
        degree = first[at + 1] - first[at]
        to = dst[np.repeat(first[at] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())]
        new = np.repeat(words, degree) & ~seen[to]
        live = np.flatnonzero(new)
        new, to, here = new[live], to[live], np.repeat((at * lanes).astype(np.int32), degree)[live]
        there = to * np.int32(lanes)
        for i in range(0, len(new), rows := BITS // lanes):
            bit = np.flatnonzero(np.unpackbits(new[i : i + rows].view(np.uint8), bitorder="little").view(bool)).astype(np.int32)
            link, bit = bit // lanes + np.int32(i), bit % lanes
            pair = here[link] + bit, there[link] + bit
            np.add.at(paths, pair[1], paths[pair[0]])
            levels.append(pair)
        np.bitwise_or.at(ahead, to, new)
        at = np.flatnonzero(ahead)
        words, ahead[at] = ahead[at], 0
        seen[at] |= words
    share = np.divide(1, paths, out=np.zeros(n * lanes), where=paths > 0)
    credit = share.copy()  # (1 + dependency) / paths
    for here, there in reversed(levels):
        np.add.at(credit, here, credit[there])
    credit[start] = 1  # a source is no node between
    credit -= share
    return np.einsum("vs,vs->v", paths.reshape(n, lanes), credit.reshape(n, lanes))


def _joined(chosen: DataFrame, simple: DataFrame, load: Row, state_rows: int) -> list[DataFrame]:
    """A table id, c of summed dependencies for each batch of the chosen sources, by joins.

    Shortest paths are searched from blocks of sources at once: a level is a table with a row for each block and node, which holds
    the numbers of shortest paths from those sources of the block that reach the node here, and a bit for each that has reached it.
    The next level is a join with the edges, summed by block and node, less what was reached before. Then the levels are walked back,
    and each node gets from those behind it its share of their paths. Levels are written tables and deleted with their batch. A hub's
    links are summed where they are read.
    """
    batches = max(1, math.ceil(load["pairs"] / state_rows))
    blocks = max(1, math.ceil(load["sources"] / batches / BLOCK))
    h = F.xxhash64("s")
    dealt = chosen.select("s", F.pmod(h, F.lit(batches)).cast("int").alias("batch"), F.pmod(F.xxhash64("s", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    place = F.row_number().over(W.Window.partitionBy("batch", "block").orderBy("s")) - 1
    dealt = cut(dealt.withColumn("place", place), "between-places")
    width = (dealt.agg(F.max("place")).first()[0] or 0) + 1
    simple = cut(simple, "between-far")
    ends = [simple.groupBy(x).count().agg(F.max("count")).first()[0] or 0 for x in ("src", "dst")]
    return [_dependencies(dealt.where(F.col("batch") == k).drop("batch"), simple, width, max(ends) > HUB) for k in range(batches)]


def _smallest_hashes(own: DataFrame, sizes: DataFrame) -> DataFrame:
    """The wanted number of each crawl's nodes, by hash of their ids: whole buckets, and the first of the bucket where the number is reached."""
    keyed = own.withColumn("h", F.xxhash64("id")).withColumn("bucket", F.shiftright("h", 52))
    before = W.Window.partitionBy("crawl").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = keyed.groupBy("crawl", "bucket").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    place = F.row_number().over(W.Window.partitionBy("crawl", "bucket").orderBy("h", "id"))
    ranked = keyed.join(counts, ["crawl", "bucket"]).join(sizes, "crawl").where(F.col("before") < F.col("wanted")).withColumn("place", place)
    return ranked.where(F.col("before") + F.col("place") <= F.col("wanted")).select("id", "crawl")


def _by_node(rows: DataFrame, width: int, finish: Callable, columns: str) -> DataFrame:
    """A row (block, id, and columns as finish gives them) for each node of a block of sources, of rows (block, id, places, amounts, own).

    places (two bytes each) say which sources of the block a row's amounts (doubles) belong to; they are summed by source and given
    to finish with the places and own of the node's row that has own, or None. Rows come sorted, so that one node is in memory at a time.
    """
    schema = f"block int, id long, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key, mine, out = np.zeros(width), None, None, []
        arrow = pa.schema([("block", pa.int32()), ("id", pa.int64()), *((n, {"binary": pa.binary(), "double": pa.float64()}[t]) for n, t in (c.split() for c in columns.split(", ")))])
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
        for batch in batches:
            for block, node, places, amounts, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, node) != key:
                    if key is not None and (found := finish(total, mine)) is not None:
                        out.append((*key, *found))
                    key, mine = (block, node), None
                    total[:] = 0.0
                    if len(out) >= 1000:
                        yield table()
                        out = []
                if own is not None:
                    mine = (places, own)
                else:
                    total[np.frombuffer(places, np.uint16)] += np.frombuffer(amounts)
        if key is not None and (found := finish(total, mine)) is not None:
            out.append((*key, *found))
        if out:
            yield table()

    return rows.select("block", "id", "places", "amounts", "own").mapInArrow(run, schema)


def _reached(total: np.ndarray, mine: tuple | None) -> tuple:
    """places and amounts of the sources that reach a node for the first time, and a bit for each source that has reached it."""
    seen = np.zeros(len(total), bool) if mine is None else np.unpackbits(np.frombuffer(mine[1], np.uint8), count=len(total)).astype(bool)
    new = np.flatnonzero((total > 0) & ~seen)
    seen[new] = True
    return (new.astype(np.uint16).tobytes() if len(new) else None, total[new].tobytes() if len(new) else None, np.packbits(seen).tobytes())


def _credited(total: np.ndarray, mine: tuple | None) -> tuple | None:
    """places, (1 + dependency) / paths of each and the sum of dependencies, where a node is of the level."""
    if mine is None:
        return None
    places, paths = np.frombuffer(mine[0], np.uint16), np.frombuffer(mine[1])
    c = paths * total[places]
    return mine[0], ((1 + c) / paths).tobytes(), float(c.sum())


def _partial(total: np.ndarray, mine: tuple | None) -> tuple:
    places = np.flatnonzero(total)
    return places.astype(np.uint16).tobytes(), total[places].tobytes()


def _dependencies(sources: DataFrame, simple: DataFrame, width: int, hubs: bool) -> DataFrame:
    """id, c: summed dependencies of the shortest paths from some sources (s, block, place) on the nodes between (Brandes' sums, level by level)."""
    null = F.lit(None).cast("binary").alias("own")

    def along(rows: DataFrame, here: str, there: str) -> DataFrame:
        sent = rows.join(simple, F.col("id") == F.col(here)).select("block", F.col(there).alias("id"), "places", "amounts", null)
        return _by_node(sent.sortWithinPartitions("block", "id"), width, _partial, "places binary, amounts binary").withColumn("own", F.lit(None).cast("binary")) if hubs else sent

    def summed(rows: DataFrame, finish: Callable, columns: str, name: str) -> DataFrame:
        return cut(_by_node(rows.repartition("block", "id").sortWithinPartitions("block", "id"), width, finish, columns), name)

    @F.pandas_udf("places binary, amounts binary")
    def one(place):
        import pandas as pd

        return pd.DataFrame({"places": [np.uint16(p).tobytes() for p in place], "amounts": [np.float64(1).tobytes()] * len(place)})

    first = sources.select("block", F.col("s").alias("id"), one("place").alias("x")).select("block", "id", "x.*", null)
    reached = "places binary, amounts binary, seen binary"
    levels = [summed(first, _reached, reached, "level")]
    while True:
        ahead = along(levels[-1].where("places is not null"), "src", "dst")
        seen = levels[-1].select("block", "id", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("amounts"), F.col("seen").alias("own"))
        level = summed(ahead.unionByName(seen), _reached, reached, "level")
        if level.where("places is not null").isEmpty():
            discard(level)
            break
        levels.append(level)
    parts: list[DataFrame] = []
    for k in range(len(levels) - 1, 0, -1):  # the sources themselves are no nodes between
        own = levels[k].where("places is not null").select("block", "id", "places", F.lit(None).cast("binary").alias("amounts"), F.col("amounts").alias("own"))
        rows = own.unionByName(along(parts[-1], "dst", "src")) if parts else own
        parts.append(summed(rows, _credited, "places binary, amounts binary, c double", "credit"))
    found = reduce(DataFrame.unionByName, [p.select("id", "c") for p in parts]) if parts else sources.select(F.col("s").alias("id"), F.lit(0.0).alias("c"))
    out = cut(found.where("c > 0").groupBy("id").agg(F.sum("c").alias("c")), "between")
    discard(*levels, *parts)
    return out


def louvain(nodes: DataFrame, edges: DataFrame, *, group: str = "crawl_id", rounds: int = 60) -> DataFrame:
    """group, id, community (numbered by the smallest id), modularity, of each crawl's undirected simple graph at resolution 1.

    Louvain's method as joins: in a round each node sees the communities of its neighbours and the one it would gain most from.
    Communities are put in another order each round, and nodes only move down in it, so that none swap, in pairs or in a ring. Into a
    community moves one of them and of the others no more than about half of what it could take before they lost by it. A round that
    lowers a crawl's modularity is taken back, and fewer move in the next.
    When nobody wants to move, communities become the nodes of the next, smaller graph. From its end result the nodes get a second
    pass over all levels. At last communities that aren't connected are parted, which never lowers the modularity. Crawls go through
    the rounds side by side, and no crawl is in one task. nodes has the group column and id; edges src and dst. Without edges each
    node is on its own.
    """
    own = cut(nodes.select(F.col(group).alias("g"), "id").distinct(), "louvain-nodes")
    one_way = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = one_way.join(own.select("g", F.col("id").alias("a")), "a").join(own.select("g", F.col("id").alias("b")), ["g", "b"])
    pairs = cut(pairs.select("g", "a", "b"), "louvain-pairs")
    few = own.select("g").distinct().limit(BROADCAST_CRAWLS + 1).count() <= BROADCAST_CRAWLS
    small = F.broadcast if few else (lambda df: df)
    links = pairs.withColumn("w", F.lit(1.0)).unionByName(pairs.select("g", F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1.0).alias("w")))
    links = cut(links, "louvain-links")
    base = cut(links.groupBy("g", F.col("a").alias("v")).agg(F.sum("w").alias("k"), F.lit(0.0).alias("loop")), "louvain-level")
    mass = cut(base.groupBy("g").agg(F.sum("k").alias("mass")), "louvain-mass")
    member: DataFrame | None = None
    for _ in range(2):
        member = _levels(base, links, mass, member, small, rounds)
    ends = [member.select("g", F.col("id").alias(x), F.col("v").alias(f"c{x}")) for x in "ab"]
    inside = pairs.join(ends[0], ["g", "a"]).join(ends[1], ["g", "b"]).where("ca = cb").select(F.struct("g", "a").alias("a"), F.struct("g", F.col("b").alias("a")).alias("b"))
    connected = components(inside, "a", "b").select(F.col("node.g").alias("g"), F.col("node.a").alias("id"), F.col("root.a").alias("first"))
    labels = cut(own.join(connected, ["g", "id"], "left").select("g", "id", F.coalesce("first", "id").alias("first")), "louvain-labels")
    names = _numbered(labels.select("g", "first").distinct())
    out = labels.join(names, ["g", "first"]).select(F.col("g").alias(group), "id", F.col("number").alias("community"))
    out = cut(out, "louvain-communities")
    return out.join(small(modularity(out, pairs.select("a", "b"), group)), group).select(group, "id", "community", "modularity")


def _levels(level: DataFrame, links: DataFrame, mass: DataFrame, start: DataFrame | None, small: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """g, id, v (community) of the nodes of a level after moves on it and on the graphs of its communities; start: communities to begin with."""
    own = member = cut(level.select("g", F.col("v").alias("id"), "v"), "louvain-members")
    begun = level.withColumn("label", F.col("v")) if start is None else level.join(start.select("g", F.col("id").alias("v"), F.col("v").alias("label")), ["g", "v"])
    while True:
        labels = _moved(begun, links, mass, small, rounds)
        if labels.where("v <> label").isEmpty():
            return member
        last, member = member, cut(member.join(labels.select("g", "v", "label"), ["g", "v"]).select("g", "id", F.col("label").alias("v")), "louvain-members")
        ends = [labels.select("g", F.col("v").alias(x), F.col("label").alias(f"c{x}")) for x in "ab"]
        whole = cut(links.join(ends[0], ["g", "a"]).join(ends[1], ["g", "b"]).groupBy("g", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "louvain-links")
        inner = whole.where("a = b").select("g", F.col("a").alias("v"), "w")
        merged = labels.groupBy("g", F.col("label").alias("v")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        joined = merged.join(inner, ["g", "v"], "left").select("g", "v", "k", (F.col("loop") + F.coalesce("w", F.lit(0.0))).alias("loop"))
        begun = cut(joined.withColumn("label", F.col("v")), "louvain-level")
        if last is not own:
            discard(last)
        links = whole.where("a <> b")


def _numbered(firsts: DataFrame) -> DataFrame:
    """g, first, number (from 0, by first) for each group, counted by buckets of ids."""
    keyed = firsts.withColumn("bucket", F.shiftright("first", 12))
    before = W.Window.partitionBy("g").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = keyed.groupBy("g", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(W.Window.partitionBy("g", "bucket").orderBy("first"))
    return keyed.join(counts, ["g", "bucket"]).select("g", "first", (F.col("before") + place - 1).alias("number"))


def _moved(level: DataFrame, links: DataFrame, mass: DataFrame, small: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """g, v, k, loop, label of the nodes of a level (g, v, k, loop, label) when none gains from moving any more, or after so many rounds."""
    now = level.withColumn("prior", F.col("label"))
    state = mass.select("g", F.lit(-2.0).alias("q"), F.lit(1.0).alias("share"), F.lit(True).alias("open"))
    best: DataFrame | None = None
    for r in range(rounds):
        total = now.groupBy("g", F.col("label").alias("c")).agg(F.sum("k").alias("t"))
        seen = links.join(now.select("g", F.col("v").alias("b"), F.col("label").alias("c")), ["g", "b"]).select("g", F.col("a").alias("v"), "c", "w")
        offers = seen.unionByName(now.select("g", "v", F.col("label").alias("c"), F.lit(0.0).alias("w"))).groupBy("g", "v", "c").agg(F.sum("w").alias("w"))
        offers = offers.join(total, ["g", "c"]).join(now, ["g", "v"]).join(small(mass), "g")
        stays = F.col("c") == F.col("label")
        gain = F.col("w") - F.col("k") * (F.col("t") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("mass")
        found = offers.withColumn("gain", gain).groupBy("g", "v").agg(
            *(F.first(c).alias(c) for c in ("k", "loop", "label", "prior", "mass")), F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("m"),
            F.max(F.when(stays, F.col("gain"))).alias("stay"), F.max(F.when(stays, F.col("w"))).alias("w"), F.max(F.when(stays, F.col("t"))).alias("t"),
        )
        wish = F.when((F.col("m.gain") > F.col("stay") + 1e-12) & (-F.col("m.c") != F.col("label")), -F.col("m.c"))
        room = (F.col("m.gain") - F.col("stay")) * F.col("mass") / F.col("k")  # what may join before the node loses by its move
        last, best = best, cut(found.select("g", "v", "k", "loop", "label", "prior", wish.alias("wish"), room.alias("room"), "w", "t"), "louvain-offers")
        # Of each community the sum over its nodes of k * t is the square of its total.
        sums = best.groupBy("g").agg(F.sum(F.col("w") + F.col("loop")).alias("inside"), F.sum(F.col("k") * F.col("t")).alias("squares"), F.count("wish").alias("movers")).join(small(mass), "g").join(small(state), "g")
        q = F.col("inside") / F.col("mass") - F.col("squares") / (F.col("mass") * F.col("mass"))
        worse = q < F.col("q") - 1e-12
        before, state = state, cut(sums.select("g", F.greatest("q", q).alias("q"), F.when(worse, F.col("share") / 2).otherwise(1.0).alias("share"), (worse | (F.col("movers") > 0)).alias("open"), worse.alias("back")), "louvain-state")
        order = lambda c, salt: F.xxhash64(c, F.lit(r), F.lit(salt))
        chance = lambda salt: F.pmod(order("v", salt), F.lit(1 << 20)) / (1 << 20)
        down = F.col("wish").isNotNull() & (order("wish", 0) < order("label", 0))
        admitted = best.where(down).groupBy("g", "wish").agg((0.5 * F.avg("room") / F.sum("k")).alias("admitted"), F.min(order("v", 1)).alias("one"))
        joined = best.join(admitted, ["g", "wish"], "left").join(small(state.select("g", "share", "back")), "g")
        moves = down & (chance(2) < F.col("share")) & ((order("v", 1) == F.col("one")) | (chance(3) < F.col("admitted")))
        label = F.when(F.col("back"), F.col("prior")).when(moves, F.coalesce("wish", "label")).otherwise(F.col("label"))
        step = cut(joined.select("g", "v", "k", "loop", label.alias("label"), F.when(F.col("back"), F.col("prior")).otherwise(F.col("label")).alias("prior")), "louvain-step")
        if last is not None:
            discard(last, before, now)
        now = step
        if state.where("open").isEmpty():
            break
    return cut(now.select("g", "v", "k", "loop", F.col("prior").alias("label")), "louvain-moved")  # what has been weighed last


def modularity(labels: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """group, modularity of the communities in labels (group, id, community) over undirected pairs (a, b)."""
    ends = [labels.select(group, F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "ab"]
    inner = pairs.join(ends[0], "a").join(ends[1].drop(group), "b")
    inside = inner.groupBy(group).agg(F.count_if(F.col("ca") == F.col("cb")).alias("inside"), F.count("*").alias("m"))
    degrees = inner.select(group, F.explode(F.array("ca", "cb")).alias("c")).groupBy(group, "c").agg(F.count("*").alias("d")).groupBy(group).agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("d2"))
    every = labels.select(group).distinct().join(inside, group, "left").join(degrees, group, "left")
    return every.select(group, F.coalesce(F.col("inside") / F.col("m") - F.col("d2") / (4.0 * F.col("m") * F.col("m")), F.lit(0.0)).alias("modularity"))


def label_propagation(nodes: DataFrame, edges: DataFrame, *, rounds: int = 10) -> DataFrame:
    """id, community: each round a node takes its neighbours' most frequent label, ties to the smallest."""
    simple = simple_edges(edges)
    both = cut(simple.unionByName(simple.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "neighbours")
    labels = nodes.select("id", F.col("id").alias("community"))
    for k in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("src"), "community"), "src").groupBy("dst", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("dst").alias("id")).agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("new"))
        labels = labels.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community"))
        labels = cut(labels, "labels") if k % 3 == 2 else labels
    return labels


def with_graph_metrics(pages: DataFrame, links: DataFrame, *, iterations: int = 40, betweenness_error: float | None = None) -> DataFrame:
    """pages with internal_page_rank, betweenness (sampled if an error is given), hub_score, authority_score, cluster_id; rank 0 for pages not indexable."""
    nodes = cut(pages.where("indexable").select("id", "crawl_id"), "graph-nodes")
    edges = cut(edges_within(links, nodes), "graph-edges")
    out = pages.drop("internal_page_rank", "betweenness", "hub_score", "authority_score", "cluster_id")
    rank = pagerank(nodes, edges, iterations=iterations).withColumnRenamed("rank", "internal_page_rank")
    scores = hits(nodes, edges).withColumnsRenamed({"hub": "hub_score", "authority": "authority_score"})
    groups = louvain(nodes, edges).select("id", F.col("community").cast("int").alias("cluster_id"))
    between = betweenness(nodes, edges, error=betweenness_error)
    for metric in (rank, scores, groups, between):
        out = out.join(metric, "id", "left")
    return out.withColumn("internal_page_rank", F.when(F.col("indexable"), F.col("internal_page_rank")).otherwise(0.0))
