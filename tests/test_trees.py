"""Trees against plain loops: deep chains, order of the queue, circles."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sitelens.operators import trees

EDGES = "src long, dst long"


def queue_tree(root, edges, rank):
    """Parents and depths as a queue gives them that takes a node's children by rank, then id."""
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    parent, depth, queue = {root: None}, {root: 0}, [root]
    for v in queue:
        for w in sorted(out[v] - depth.keys(), key=lambda w: (-rank[w], w)):
            parent[w], depth[w] = v, depth[v] + 1
            queue.append(w)
    return {v: (parent[v], depth[v]) for v in depth}


def levelled(root, edges, rank):
    """The same with levels: a node's parent is the first of the level above, in the queue's order, that links to it."""
    links = {(a, b) for a, b in edges if a != b}
    found, level = {root: (None, 0)}, [root]
    while level:
        new = []
        for k, v in enumerate(level):
            for w in sorted((b for a, b in links if a == v), key=lambda w: (-rank[w], w)):
                if w not in found:
                    found[w] = (v, found[v][1] + 1)
                    new.append(w)
        level = new
    return found


@pytest.mark.parametrize("seed", range(2))
def test_link_tree_is_the_queues(spark, seed):
    rng = random.Random(seed)
    n = 90
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)] + [(0, i) for i in range(1, 9)] + [(n - 2, n - 1)]
    rank = {i: rng.choice([0.1, 0.2, 0.2, 0.3]) for i in range(n)}
    pages = spark.createDataFrame([(i, f"https://a.com/{i or ''}", rank[i]) for i in range(n)], "id long, normalized_url string, internal_page_rank double")
    got = {r["id"]: (r["parent_id"], r["depth"]) for r in trees.link_tree(pages, spark.createDataFrame(edges, EDGES)).collect() if not r["is_orphan"]}
    assert got == queue_tree(0, edges, rank) == levelled(0, edges, rank) and len(got) > 40


def test_link_tree_has_no_deepest_level(spark, monkeypatch):
    monkeypatch.setattr(trees, "TOGETHER", 4)
    edges = [(i, i + 1) for i in range(30)] + [(7, 3), (30, 0)]
    pages = spark.createDataFrame([(i, f"https://a.com/{i or ''}", 0.1) for i in range(32)], "id long, normalized_url string, internal_page_rank double")
    got = {r["id"]: (r["parent_id"], r["depth"], r["is_orphan"]) for r in trees.link_tree(pages, spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {i: (i - 1 if i else None, i, False) for i in range(31)} | {31: (None, None, True)}


def test_sizes_and_depths(spark):
    """A chain of 5,000, a star, a random tree, lone nodes: counted in as many rounds as the depth has digits; a circle is an error."""
    rng = random.Random(4)
    parent = {i: i - 1 if i else None for i in range(5000)} | {10_000: None} | {10_000 + i: 10_000 for i in range(1, 300)}
    parent |= {20_000: None, 30_000: None} | {20_000 + i: 20_000 + rng.randrange(i) for i in range(1, 500)}
    size, depth, root = dict.fromkeys(parent, 1), {}, {}
    for v in sorted(parent):
        up = parent[v]
        depth[v], root[v] = (0, v) if up is None else (depth[up] + 1, root[up])
    for v in sorted(parent, reverse=True):
        if parent[v] is not None:
            size[parent[v]] += size[v]
    tree = spark.createDataFrame([*parent.items()], "id long, parent_id long").withColumn("over", F.lit("clash"))
    assert {r["id"]: r["size"] for r in trees.subtree_sizes(tree).collect()} == size
    assert {r["id"]: (r["root_id"], r["depth"]) for r in trees.roots_and_depths(tree).collect()} == {v: (root[v], depth[v]) for v in parent}
    assert trees.subtree_sizes(tree.where("false")).count() == 0
    with pytest.raises(ValueError, match="circle"):
        trees.subtree_sizes(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent_id long"))
