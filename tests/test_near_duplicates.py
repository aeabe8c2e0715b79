"""Near-duplicates by fingerprint against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sitelens.functions.components import components
from sitelens.operators import near_duplicates as nd
from sitelens.operators import rules

PAGES = "crawl_id string, id long, normalized_url string, simhash string, content_hash string, word_count int, indexable boolean"


def gap(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def site(seed, n=260):
    """Pages of a few families of fingerprints, bits changed anywhere; one fingerprint holds a third; equal and unknown contents."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(8)]
    rows = []
    for i in range(n):
        x = base[0] if i % 3 == 0 else rng.choice(base)
        if i % 3:
            for b in rng.sample(range(64), rng.choice([0, 1, 3, 4, 6, 7, 9])):
                x ^= 1 << b
        rows.append((rng.choice("AAB"), i, f"u{i}", f"{x:016x}", rng.choice(["c1", "c2", None, f"own {i}"]), rng.choice([80, 80, 80, 10]), rng.random() < 0.95))
    return [*rows, ("A", n, f"u{n}", None, "c1", 90, True), ("A", n + 1, f"u{n + 1}", "f" * 16, "c1", 90, True)]


def brute(rows):
    own = [r for r in rows if r[6] and r[3] is not None and r[5] >= 50]
    near = {r[1]: [] for r in own}
    for a in own:
        for b in own:
            if a[1] != b[1] and a[0] == b[0] and (a[4] is None or a[4] != b[4]) and gap(a[3], b[3]) <= 6:
                near[a[1]].append((gap(a[3], b[3]), b[1]))
    return near


@pytest.mark.parametrize("blocks", [7, 8, 9, 10])
def test_every_near_pair_meets_once(spark, monkeypatch, blocks):
    rng = random.Random(blocks)
    prints = {f"{rng.getrandbits(64):016x}" for _ in range(30)}
    for s in [*prints][:20]:
        for d in range(1, 9):
            x = int(s, 16)
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            prints.add(f"{x:016x}")
    monkeypatch.setattr(nd, "index_plan", lambda n, distance: (blocks, blocks - distance))
    got = [(r["simhash_a"], r["simhash_b"], r["distance"]) for r in nd.near_prints(spark.createDataFrame([(s,) for s in prints], "simhash string"), []).collect()]
    want = {(a, b, gap(a, b)) for a in prints for b in prints if a < b and gap(a, b) <= 6}
    assert len(got) == len(want) and set(got) == want and len(want) > 100


def test_groups_and_nearest(spark):
    rows = site(1)
    pages, near = spark.createDataFrame(rows, PAGES), brute(rows)
    got = {r["id"]: (r["distance"], r["other_id"]) for r in nd.nearest_duplicates(pages).collect()}
    assert got == {i: min(x) for i, x in near.items() if x} and len(got) > 100
    root = {i: i for i, x in near.items() if x}
    while True:
        new = {i: min([root[i], *(root[j] for _, j in near[i])]) for i in root}
        if new == root:
            break
        root = new
    found = {r["id"]: (r["group_id"], r["group_pages"]) for r in nd.near_duplicate_groups(pages).collect()}
    assert found == {i: (g, sum(x == g for x in root.values())) for i, g in root.items()}
    said = {r["page_id"]: r["details"] for r in rules.near_duplicate_findings(pages.drop("crawl_id").where("crawl_id = 'A'")).collect()}
    assert said and all(said[i] == f"{int((64 - d) / 64 * 100 + 0.5)}% similar a u{j}" for i, (d, j) in got.items() if i in said)
    none = spark.createDataFrame([], PAGES)
    assert nd.near_duplicate_groups(none).count() == 0 and nd.nearest_duplicates(none).count() == 0


def test_hot_fingerprint_costs_its_rows(spark):
    """Thousands of pages of one fingerprint give a row each; two million pairs are never made."""
    pages = spark.range(2000).selectExpr("'A' AS crawl_id", "id", "concat('u', id) AS normalized_url", "'00000000000000ff' AS simhash", "concat('c', id) AS content_hash", "90 AS word_count", "true AS indexable")
    out = nd.nearest_duplicates(pages).collect()
    assert {r["id"]: r["other_id"] for r in out} == {i: 1 if i == 0 else 0 for i in range(2000)}
    groups = nd.near_duplicate_groups(pages).agg(F.count("*").alias("n"), F.max("group_id").alias("g"), F.min("group_pages").alias("p")).first()
    assert (groups["n"], groups["g"], groups["p"]) == (2000, 0, 2000)


def test_index_plan():
    assert [nd.index_plan(n) for n in (0, 1000, 10**5, 10**7, 10**12)] == [(7, 1), (7, 1), (8, 2), (9, 3), (11, 5)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(120)] + [(5000, 5000), (6000, 7000)] * 2
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in sorted(pairs, key=min, reverse=True):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
