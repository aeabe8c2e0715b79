"""Graph metrics against plain loops on small graphs."""

import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators import graph

EDGES = "src long, dst long"


def brandes(n, edges):
    """Betweenness of nodes 0 to n - 1, by a queue for each source."""
    out, total = defaultdict(set), [0.0] * n
    for a, b in edges:
        if a != b:
            out[a].add(b)
    for s in range(n):
        paths, distance, before, order, queue = defaultdict(float, {s: 1.0}), {s: 0}, defaultdict(list), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in distance:
                    distance[w] = distance[v] + 1
                    queue.append(w)
                if distance[w] == distance[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        credit = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                credit[v] += paths[v] / paths[w] * (1 + credit[w])
            if w != s:
                total[w] += credit[w]
    return [x / ((n - 1) * (n - 2)) if n > 2 else x for x in total]


def nodes_of(spark, *sizes):
    return spark.createDataFrame([(1000 * k + i, f"crawl {k}") for k, n in enumerate(sizes) for i in range(n)], "id long, crawl_id string")


def test_betweenness_is_exact(spark):
    """Two crawls, in one batch and in several; parallel and self links, parts that aren't connected, a hub, a long chain."""
    rng = random.Random(6)
    one = [(rng.randrange(40), rng.randrange(40)) for _ in range(110)] + [(i, 0) for i in range(40)] + [(3, 3), (1, 2), (1, 2)]
    two = [(i, i + 1) for i in range(12)] + [(20, 21)]
    edges = spark.createDataFrame([*one, *((a + 1000, b + 1000) for a, b in two), (5, 99_999)], EDGES)
    want = dict(enumerate(brandes(40, one))) | {1000 + i: x for i, x in enumerate(brandes(22, two))}
    for rows in (10**9, 700):
        got = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes_of(spark, 40, 22), edges, state_rows=rows).collect()}
        assert got == pytest.approx(want, abs=1e-12)
    assert {r["betweenness"] for r in graph.betweenness(nodes_of(spark, 3), spark.createDataFrame([], EDGES)).collect()} == {0.0}
    assert graph.betweenness(nodes_of(spark), edges).count() == 0


def test_betweenness_holds_a_row_for_each_block_and_node(spark, monkeypatch):
    """Two blocks of sources, hubs whose links are summed before the shuffle: no table has a row for each pair."""
    rng = random.Random(9)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(70)] + [(i, 0) for i in range(30)] + [(0, i) for i in range(30)]
    rows, write = [], graph.cut

    def counted(df, name="step"):
        out = write(df, name)
        rows.extend([out.count()] if name in ("level", "credit") else [])
        return out

    monkeypatch.setattr(graph, "cut", counted)
    monkeypatch.setattr(graph, "BLOCK", 15, raising=False)
    monkeypatch.setattr(graph, "HUB", 4, raising=False)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes_of(spark, 30), spark.createDataFrame(edges, EDGES)).collect()}
    assert got == pytest.approx(dict(enumerate(brandes(30, edges))), abs=1e-12)
    assert rows and max(rows) <= 60


@pytest.mark.parametrize("task_bytes", [512 << 20, 10_000, 0])
def test_betweenness_shuffles_links_and_sums_only(spark, monkeypatch, task_bytes):
    """Blocks of few sources, links in parts, a chain: no level is a table, unless a crawl takes too much for a task."""
    rng = random.Random(11)
    one = [(rng.randrange(40), rng.randrange(40)) for _ in range(120)] + [(0, i) for i in range(40)] + [(3, 3), (1, 2)]
    two = [(i, i + 1) for i in range(12)] + [(20, 21)]
    edges = spark.createDataFrame([*one, *((a + 1000, b + 1000) for a, b in two), (5, 1003), (1004, 5)], EDGES)
    want = dict(enumerate(brandes(40, one))) | {1000 + i: x for i, x in enumerate(brandes(22, two))}
    names, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="step": names.append(name) or write(df, name))
    for name, value in (("TASK_BYTES", task_bytes), ("TASK_SOURCES", 7), ("PACKED", 9), ("TASKS", 3)):
        monkeypatch.setattr(graph, name, value, raising=False)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes_of(spark, 40, 22), edges).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    assert (names.count("level") == 0) == (task_bytes > 10_000)


@pytest.mark.parametrize("lanes", [8, 16, 32, 64])
def test_credits_of_many_sources_at_once(lanes):
    rng = random.Random(lanes)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(400)) if a != b} | {(i, i + 1) for i in range(150, 299)})
    first, dst = np.searchsorted([a for a, _ in pairs], range(301)), np.array([b for _, b in pairs], np.int32)
    shares = [graph._credits(np.arange(k, min(k + lanes, 300)), first, dst, lanes) for k in range(0, 300, lanes)]
    assert sum(shares) / (299 * 298) == pytest.approx(np.array(brandes(300, pairs)), abs=1e-12)
    assert not sum(shares)[[299]].any() and min(map(np.min, shares)) >= 0


def test_betweenness_of_samples(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(400)]
    want = brandes(150, edges)
    assert graph.sources_for(150, 0.3) < 100 < graph.sources_for(150, 0.05) == 150 and graph.sources_for(10**9, 0.01) < 130_000
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes_of(spark, 150), spark.createDataFrame(edges, EDGES), error=0.2).collect()}
    assert len(got) == 150 and max(abs(got[i] - want[i]) for i in range(150)) < 0.2
    sizes = spark.createDataFrame([("crawl 0", 37)], "crawl string, wanted long")
    own = nodes_of(spark, 150).select("id", F.col("crawl_id").alias("crawl"))
    chosen = sorted(r["id"] for r in graph._smallest_hashes(own, sizes).collect())
    assert chosen == sorted(r["id"] for r in own.orderBy(F.xxhash64("id"), "id").limit(37).collect())


def louvain_loop(n, pairs, seed=7):
    """Modularity that moving one node after another reaches, level by level."""
    rng, total = random.Random(seed), 2.0 * len(pairs)
    web, loops = {v: defaultdict(float) for v in range(n)}, dict.fromkeys(range(n), 0.0)
    for a, b in pairs:
        web[a][b] = web[b][a] = 1.0
    while True:
        degree = {v: sum(x.values()) + loops[v] for v, x in web.items()}
        label, mass, any_moved, moved = {v: v for v in web}, dict(degree), False, True
        order = [*web]
        rng.shuffle(order)
        while moved:
            moved = False
            for v in order:
                near = defaultdict(float)
                for u, w in web[v].items():
                    near[label[u]] += w
                mass[label[v]] -= degree[v]
                gains = {c: w - mass[c] * degree[v] / total for c, w in near.items()} | {label[v]: near.get(label[v], 0.0) - mass[label[v]] * degree[v] / total}
                best = max(gains, key=lambda c: (gains[c], c == label[v]))
                mass[best] += degree[v]
                if gains[best] > gains[label[v]] + 1e-12:
                    label[v], moved, any_moved = best, True, True
        if not any_moved:
            return sum(loops[v] / total - (degree[v] / total) ** 2 for v in web)
        bigger, inner = {c: defaultdict(float) for c in {*label.values()}}, defaultdict(float)
        for v, x in web.items():
            inner[label[v]] += loops[v]
            for u, w in x.items():
                if label[u] == label[v]:
                    inner[label[v]] += w
                else:
                    bigger[label[v]][label[u]] += w
        web, loops = bigger, {c: inner[c] for c in bigger}


def test_louvain_reaches_the_modularity_of_single_moves(spark):
    """Planted groups of several strengths, a ring of cliques, a hub, isolated nodes: four crawls side by side, against the best of five loops."""
    rng = random.Random(11)
    crawls = []
    for n, parts, inner, outer in ((120, 6, 0.4, 0.02), (150, 5, 0.2, 0.03)):
        crawls.append((n, {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (inner if a % parts == b % parts else outer)}))
    crawls.append((80, {(5 * k + i, 5 * k + j) for k in range(16) for i in range(5) for j in range(i + 1, 5)} | {(5 * k, (5 * k + 6) % 80) for k in range(15)}))
    crawls.append((60, {(0, i) for i in range(1, 50)} | {(i, i + 1) for i in range(1, 49, 2)}))
    edges = spark.createDataFrame([(1000 * k + a, 1000 * k + b) for k, (_, pairs) in enumerate(crawls) for a, b in pairs], EDGES)
    rows = graph.louvain(nodes_of(spark, *(n for n, _ in crawls), 3), edges).collect()
    assert len(rows) == sum(n for n, _ in crawls) + 3
    for k, (n, pairs) in enumerate(crawls):
        label = {r["id"] - 1000 * k: r["community"] for r in rows if r["crawl_id"] == f"crawl {k}"}
        degree = [sum(v in p for p in pairs) for v in range(n)]
        found = sum(label[a] == label[b] for a, b in pairs) / len(pairs) - sum((sum(degree[v] for v in range(n) if label[v] == c) / (2 * len(pairs))) ** 2 for c in {*label.values()})
        assert [*{r["modularity"] for r in rows if r["crawl_id"] == f"crawl {k}"}] == [pytest.approx(found)]
        assert found >= 0.99 * max(louvain_loop(n, pairs, seed) for seed in range(5)), k
        first = {}
        for v in range(n):  # numbered by first node; each community is connected
            first.setdefault(label[v], v)
        assert [*first] == [*range(len(first))]
        for c in first:
            reached, more = {first[c]}, [first[c]]
            while more:
                v = more.pop()
                new = {b if a == v else a for a, b in pairs if v in (a, b)} - reached
                new = {u for u in new if label[u] == c}
                reached |= new
                more += new
            assert reached == {v for v in range(n) if label[v] == c}


def test_louvain_joins_pairs_at_once(spark, monkeypatch):
    """Pairs that want to swap are joined in the first round, so that nobody waits for chance."""
    rounds, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="step": rounds.append(name) or write(df, name))
    edges = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(300)], EDGES)
    rows = graph.louvain(nodes_of(spark, 600), edges).collect()
    assert {r["id"]: r["community"] for r in rows} == {i: i // 2 for i in range(600)}
    assert rounds.count("louvain-offers") <= 6


def hits_loop(nodes, edges, rounds):
    """Hubs and authorities of one graph, each round scaled."""
    simple = sorted({e for e in edges if e[0] != e[1]})
    sums = lambda pairs, x: {b: sum(x.get(a, 0.0) for a, c in pairs if c == b) for b in {b for _, b in pairs}}
    scaled = lambda x: {k: v / sum(x.values()) for k, v in x.items()}
    hubs = dict.fromkeys((a for a, _ in simple), 1.0)
    for _ in range(rounds):
        hubs = scaled(sums([(b, a) for a, b in simple], sums(simple, hubs)))
    found = scaled(sums(simple, hubs)) if simple else {}
    return {i: (hubs.get(i, 0.0), found.get(i, 0.0)) for i in nodes}


def shuffled_rows(spark):
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_hits_over_blocks(spark):
    rng = random.Random(11)
    one = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)] + [(i, 7) for i in range(40)] + [(3, 3), (9, 7), (9, 7)]
    two = [(rng.randrange(100, 130), rng.randrange(100, 130)) for _ in range(90)]
    nodes = spark.createDataFrame([*((i, "A") for i in range(45)), *((i, "B") for i in range(100, 130))], "id long, crawl_id string")
    edges = spark.createDataFrame([*one, *two], "src long, dst long")
    want = hits_loop(range(45), one, 10) | hits_loop(range(100, 130), two, 10)
    for block in (6, 1000):
        got = {r["id"]: (r["hub"], r["authority"]) for r in graph.hits(nodes, edges, iterations=10, tolerance=0, block=block).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_hits_shuffles_blocks(spark):
    """A round shuffles rows of blocks, not of links: ten more rounds cost less than one shuffle of the links."""
    nodes = spark.range(2000)
    edges = nodes.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("n")).select("src", F.pmod(F.col("src") * 31 + F.col("n") * 17, F.lit(2000)).alias("dst"))
    seen, cost = set(shuffled_rows(spark)), []
    for rounds in (5, 15):
        graph.hits(nodes, edges, iterations=rounds, tolerance=0, every=rounds).collect()
        now = shuffled_rows(spark)
        cost.append(sum(x for k, x in now.items() if k not in seen))
        seen |= set(now)
    assert cost[1] - cost[0] < 20_000
