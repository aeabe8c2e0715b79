"""Operators on small hand-made crawls, graphs and histories; invariants of graph metrics."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from sitelens.operators import compare, graph, inventory, keywords, links, rules, sinks, stats, trees
from sitelens.plans.crawl_view import crawl_links, crawl_pages

EDGES = "src long, dst long"


def ids(spark, n):
    return spark.range(n).select("id", F.lit("A").alias("crawl_id"))


def pagerank_loop(n, edges, rounds, d=0.85):
    out = [[b for a, b in edges if a == i and b != i] for i in range(n)]
    rank = [1 / n] * n
    for _ in range(rounds):
        lost = sum(r for r, o in zip(rank, out, strict=True) if not o)
        new = [(1 - d) / n + d * lost / n] * n
        for i, o in enumerate(out):
            for j in o:
                new[j] += d * rank[i] / len(o)
        rank = new
    return rank


def test_pagerank(spark):
    edges = [(0, 1), (0, 1), (0, 2), (1, 2), (2, 2), (2, 0), (1, 3)]
    got = {r["id"]: r["rank"] for r in graph.pagerank(ids(spark, 4), spark.createDataFrame(edges, EDGES), iterations=12, tolerance=0).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(pagerank_loop(4, edges, 12)) and sum(got.values()) == pytest.approx(1)
    alone = graph.pagerank(ids(spark, 3), spark.createDataFrame([], EDGES), iterations=5).collect()
    assert [r["rank"] for r in alone] == pytest.approx([1 / 3] * 3) and graph.pagerank(ids(spark, 0), spark.createDataFrame([], EDGES)).count() == 0


def test_metrics(spark):
    path = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], EDGES)
    between = {r["id"]: r["betweenness"] for r in graph.betweenness(ids(spark, 4), path).collect()}
    assert between == pytest.approx({0: 0, 1: 2 / 6, 2: 2 / 6, 3: 0})
    star = graph.hits(ids(spark, 4), spark.createDataFrame([(0, 1), (0, 2), (0, 3)], EDGES)).collect()
    assert {r["id"]: (round(r["hub"], 6), round(r["authority"], 6)) for r in star} == {0: (1.0, 0.0), 1: (0.0, 0.333333), 2: (0.0, 0.333333), 3: (0.0, 0.333333)}
    clique = [(a, b) for k in (0, 5) for a in range(k, k + 5) for b in range(k, k + 5) if a != b] + [(4, 5)]
    found = {r["id"]: (r["community"], r["modularity"]) for r in graph.louvain(ids(spark, 10), spark.createDataFrame(clique, EDGES)).collect()}
    assert {found[i][0] for i in range(5)} == {0} and {found[i][0] for i in range(5, 10)} == {1} and found[0][1] > 0.4
    single = graph.louvain(ids(spark, 3), spark.createDataFrame([], EDGES)).collect()
    assert len({r["community"] for r in single}) == 3
    spread = {r["id"]: r["community"] for r in graph.label_propagation(ids(spark, 10), spark.createDataFrame(clique, EDGES), rounds=4).collect()}
    assert len({spread[i] for i in range(4)}) == 1 and len({spread[i] for i in range(6, 10)}) == 1


def test_trees(spark):
    pages = spark.createDataFrame([(0, "https://a.com/", 0.1), (1, "https://a.com/x", 0.5), (2, "https://a.com/y", 0.9), (3, "https://a.com/x/z", 0.2), (4, "https://a.com/lost", 0.3)], "id long, normalized_url string, internal_page_rank double")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (4, 4)], EDGES)
    tree = trees.link_tree(pages, edges)
    assert {r["id"]: (r["parent_id"], r["depth"], r["is_orphan"]) for r in tree.collect()} == {0: (None, 0, False), 1: (0, 1, False), 2: (0, 1, False), 3: (2, 2, False), 4: (None, None, True)}
    assert sorted((r["src"], r["dst"]) for r in trees.cross_links(tree, edges).collect()) == [(1, 3), (3, 0)]
    assert {r["id"]: r["size"] for r in trees.subtree_sizes(tree.select("id", "parent_id")).collect()} == {0: 4, 1: 1, 2: 2, 3: 1, 4: 1}
    shown = {r["id"]: (r["visible"], r["hidden_children"]) for r in trees.pruned(tree.select("id", "parent_id"), pages.select("id", F.col("internal_page_rank").alias("rank")), most=1).collect()}
    assert shown[2] == (True, 0) and shown[1] == (False, 0) and shown[0] == (True, 1)
    paths = {r["node_id"]: (r["parent_id"], r["depth"], r["pages"], r["page_id"]) for r in trees.path_tree(pages).collect()}
    assert paths["/"] == (None, 0, 5, 0) and paths["/x"] == ("/", 1, 2, 1) and paths["/x/z"] == ("/x", 2, 1, 3)


def test_rules_only_touch_pages(spark, sf):
    pages = links.with_link_metrics(crawl_pages(spark, sf), links.resolve_targets(crawl_links(spark, sf), crawl_pages(spark, sf)))
    found = rules.page_findings(pages.withColumn("resource_type", F.lit("IMAGE")).withColumn("title", F.lit(None).cast("string"))).select("code").distinct().collect()
    assert {r["code"] for r in found} <= {"HTTP_5XX", "HTTP_4XX", "FETCH_ERROR", "REDIRECT_LOOP", "REDIRECT", "BLOCKED_ROBOTS", "MIME_MISMATCH", "BROKEN_ASSET"}
    every = rules.all_findings(pages.withColumn("simhash", F.lit(None).cast("string")), links.resolve_targets(crawl_links(spark, sf), crawl_pages(spark, sf)))
    assert every.columns == rules.FINDING and every.where("code is null or severity is null or title is null").count() == 0
    health = stats.seo_health(every, pages).first()
    assert 0 <= health["seo_health"] <= 100


def test_near_duplicates_and_hreflang(spark):
    rows = [(1, "0000000000000000", "a"), (2, "0000000000000000", "b"), (3, "000000000000003f", "c"), (4, "000fffffffffffff", "d"), (5, "0000000000000000", "a")]
    pages = spark.createDataFrame([(i, f"u{i}", s, c, 80, True) for i, s, c in rows], "id long, normalized_url string, simhash string, content_hash string, word_count int, indexable boolean")
    pairs = {(r["id_a"], r["id_b"]): r["similarity"] for r in rules.near_duplicate_pairs(pages).collect()}
    assert pairs == {(1, 2): 100, (2, 5): 100, (1, 3): 91, (2, 3): 91, (3, 5): 91}
    site = spark.createDataFrame([(1, "A", 200), (2, "B", 200), (3, "C", 404)], "id long, normalized_url string, status_code int")
    lang = spark.createDataFrame([(1, "A", "es"), (1, "B", "en"), (1, "C", "fr"), (2, "B", "es_ES"), (2, "D", "de"), (3, "B", "en")], "page_id long, href string, language string")
    got = sorted((r["page_id"], r["code"], r["details"]) for r in rules.hreflang_findings(lang, site).collect() if r["code"] != "HREFLANG_MISSING_SELF")
    assert got == [(1, "HREFLANG_BROKEN_TARGET", "C (404)"), (1, "HREFLANG_NOT_RECIPROCAL", "B · C"), (2, "HREFLANG_INVALID_CODE", "es_ES"), (3, "HREFLANG_NOT_RECIPROCAL", "B")]


def test_images(spark):
    pages = spark.createDataFrame([(1, "A", "p", "h1", 200, "HTML_PAGE"), (2, "A", "i", "h2", 404, "ERROR"), (3, "A", "j", "h3", None, "ERROR")], "id long, crawl_id string, normalized_url string, url_hash string, status_code int, resource_type string")
    images = spark.createDataFrame([(1, "h2", None, False), (1, "h2", "", True), (1, "h3", "x", True), (1, None, "x", True)], "page_id long, url_hash string, alt string, has_alt boolean")
    assert {(r["image_url"], r["status_code"], r["appearances"]) for r in links.broken_images(images, pages).collect()} == {("i", 404, 2), ("j", None, 1)}
    one = stats.image_stats(images, pages).first()
    assert (one["elements"], one["missing_alt"], one["decorative_alt"], one["described_alt"], one["pages_with_missing_alt"], one["missing_alt_ratio"]) == (4, 1, 1, 2, 1, 0.25)
    export = sinks.images_csv(images.select("*", F.lit("s").alias("src"), F.lit(None).cast("int").alias("width"), F.lit(1).alias("height"), F.lit("").alias("loading"), F.lit("").alias("srcset")), pages).collect()
    assert len(export) == 4 and {r["alt_state"] for r in export} == {"MISSING", "DECORATIVE", "DESCRIPTIVE"}


def test_compare(spark):
    schema = "url_hash string, normalized_url string, status_code int, indexability_reason string"
    a = spark.createDataFrame([("1", "1", None, "FETCH_ERROR"), ("2", "2", 200, "INDEXABLE"), ("3", "3", 200, "INDEXABLE")], schema)
    b = spark.createDataFrame([("1", "1", 200, "INDEXABLE"), ("2", "2", 200, "NOINDEX"), ("4", "4", None, "FETCH_ERROR")], schema)
    assert {r["change"]: r["count"] for r in compare.comparison_counts(a, b).collect()} == {"added": 1, "removed": 1, "status_changed": 1, "indexability_changed": 2}
    crawls = spark.createDataFrame([(1, 9, "COMPLETED", 1), (2, 9, "FAILED", 2), (3, 9, "COMPLETED", 3), (4, 8, "COMPLETED", 1)], "id long, project_id long, status string, created_at int")
    assert {r["project_id"]: (r["target_id"], r["base_id"]) for r in compare.latest_two(crawls).collect()} == {9: (3, 1), 8: (4, None)}


def test_keywords(spark):
    days = [(1, 1, 5.0), (1, 2, None), (1, 3, 3.0), (1, 4, 9.0), (2, 1, None), (2, 2, 4.0)]
    history = spark.createDataFrame([(k, date(2024, 1, d), p) for k, d, p in days], "keyword_id long, date date, position double")
    got = [(r["previous_position"], r["best_position"]) for r in keywords.with_previous_and_best(history).orderBy("keyword_id", "date").collect()]
    assert got == [(None, 5.0), (5.0, 5.0), (5.0, 3.0), (3.0, 3.0), (None, None), (None, 4.0)]
    plain = [r["previous_position"] for r in keywords.with_previous_and_best(history, skip_null=False).orderBy("keyword_id", "date").collect()]
    assert plain == [None, 5.0, None, 3.0, None, None]
    rows = spark.createDataFrame([("A b", 2.0, 5, 0), ("a  B", 2.0, 9, 1), ("c", 1.0, 0, 2)], "query string, position double, impressions long, input_order int")
    best = {r["normalized"]: r["input_order"] for r in keywords.best_per_query(rows).collect()}
    assert best == {"a b": 0, "c": 2} and [r["normalized"] for r in keywords.discover(rows, spark.createDataFrame([("a b",)], "normalized string")).collect()] == ["a b"]
    checks = spark.createDataFrame([(1, i, 0.5) for i in range(5)], "project_id long, keyword_id long, cost_usd double")
    assert keywords.affordable(checks, 1.2).count() == 2 and keywords.estimate_cost(100) == {"run": 0.5, "month": 15.0}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (2, "c"), (3, "d")], "k int, v string")
    assert sorted(sinks.upserted(a, new, ["k"], F.col("v")).collect()) == [(1, "x"), (2, "c"), (3, "d")] and {r["k"] for r in sinks.absent(new, a, ["k"]).collect()} == {3}
    sinks.write_csv(sinks.as_text(a), str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("﻿k,v\n") and "1,x" in text
    path = str(tmp_path / "parts")
    sinks.replace_partitions(a.withColumn("d", F.lit(1)), path, "d")
    sinks.replace_partitions(new.withColumn("d", F.lit(2)), path, "d")
    sinks.replace_partitions(new.where("k = 3").withColumn("d", F.lit(2)), path, "d")
    assert spark.read.parquet(path).count() == 3
    assert sinks.render_markdown("T", [("A", "text"), ("B", a)]) == "# T\n\n## A\n\ntext\n\n## B\n\n| k | v |\n| --- | --- |\n| 1 | x |\n| 2 |  |\n"
    assert sinks.export_audit(sinks.as_text(a), "a.csv").first()["rows"] == 2


def test_inventory(spark, sf):
    pages, edges = crawl_pages(spark, sf), links.resolve_targets(crawl_links(spark, sf), crawl_pages(spark, sf))
    metrics = links.with_link_metrics(pages, edges)
    nodes, within = inventory.subgraph(metrics, edges, limit=10)
    assert nodes.count() == 10 and within.where("src = dst").count() == 0
    url = pages.orderBy("id").first()["normalized_url"]
    assert inventory.find_page(pages, url).first()["normalized_url"] == url
    found = rules.page_findings(metrics).cache()
    run = lambda name, **extra: inventory.TOOLS[name](metrics, edges, found, **extra)
    rows = {r["id"]: r for r in metrics.collect()}
    top = sorted((r for r in rows.values() if r["indexable"]), key=lambda r: (-r["internal_page_rank"], r["id"]))[:20]
    assert [r["id"] for r in run("getTopPagesByPageRank").collect()] == [r["id"] for r in top] and len(top) == 20
    thin = sorted(r["page_id"] for r in found.where("code = 'THIN_CONTENT'").collect())[:25]
    assert thin and [r["id"] for r in run("getPagesByIssue", code="THIN_CONTENT").collect()] == thin
    links_of = [r for r in edges.collect() if r["link_type"] == "INTERNAL" and r["target_page_id"] is not None]
    bad = [r for r in links_of if (rows[r["target_page_id"]]["status_code"] or 0) >= 400]
    assert bad and run("getBrokenLinks").count() == min(25, len(bad)) and all(r["status_code"] >= 400 for r in run("getBrokenLinks").collect())
    assert run("getLinksFromPage", page_id=1).count() == sum(r["source_page_id"] == 1 for r in edges.collect()) > 0
    assert {r["target_page_id"] for r in run("getLinksToPage", page_id=2).collect()} == {2}
    summary = {(r["part"], r["key"]): r["value"] for r in run("getCrawlSummary").collect()}
    assert summary["totals", "requested_urls"] == len(rows) and summary["status", "2xx"] == sum(200 <= (r["status_code"] or 0) < 300 for r in rows.values())
    assert run("getLowInlinkPages").collect() and all(r["internal_inlinks"] <= 1 and r["depth"] > 0 and r["indexable"] for r in run("getLowInlinkPages").collect())
    assert [r["depth"] for r in run("getDeepPages").collect()] == sorted((r["depth"] for r in run("getDeepPages").collect()), reverse=True) != []
    details = inventory.page_details(1, metrics, edges, found)
    assert details["page"].count() == 1 and details["outlinks"].count() > 0
    rows, counts = inventory.load_pages(metrics, 10, status="2xx")
    assert rows.count() == 10 and counts.first()["truncated"] and counts.first()["rendered"] == 10


def test_random_graph_mass(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(30), rng.randrange(25)) for _ in range(80)]
    got = {r["id"]: r["rank"] for r in graph.pagerank(ids(spark, 30), spark.createDataFrame(edges, EDGES), iterations=8, tolerance=0).collect()}
    assert [got[i] for i in range(30)] == pytest.approx(pagerank_loop(30, edges, 8))


def test_every_page_code_fires(spark):
    pages = crawl_pages(spark, "/root/testdata/sf0.01")
    metrics = links.with_link_metrics(pages, links.resolve_targets(crawl_links(spark, "/root/testdata/sf0.01"), pages))
    assert {r["code"] for r in rules.page_findings(metrics).select("code").distinct().collect()} == {r.code for r in rules.page_rules()}


def test_crawls_stay_apart(spark):
    """Two crawls in one table: images, duplicates, near-duplicates, PageRank and HITS are those of each alone."""
    pages = spark.createDataFrame([(1, "A", "h", 200), (2, "B", "h", 404), (3, "A", "p", 200), (4, "B", "p", 200)], "id long, crawl_id string, url_hash string, status_code int")
    images = spark.createDataFrame([(3, "h"), (4, "h"), (4, "none")], "page_id long, url_hash string")
    assert sorted((r["page_id"], r["url_hash"], r["image_status"]) for r in links.image_statuses(images, pages).collect()) == [(3, "h", 200), (4, "h", 404), (4, "none", None)]
    titled = spark.createDataFrame([(1, "A", "t"), (2, "B", "t"), (3, "A", "u"), (4, "A", "u")], "id long, crawl_id string, title string").selectExpr("*", "'x' AS normalized_url", "true AS indexable", "'HTML_PAGE' AS resource_type")
    assert sorted((r["id"], r["cnt"]) for r in rules.duplicates(titled, "title").collect()) == [(3, 2), (4, 2)]
    prints = spark.createDataFrame([(1, "A", "0" * 16, "a"), (2, "B", "0" * 16, "b"), (3, "A", "0" * 15 + "1", "c")], "id long, crawl_id string, simhash string, content_hash string").selectExpr("*", "'x' AS normalized_url", "true AS indexable", "80 AS word_count")
    assert [(r["id_a"], r["id_b"]) for r in rules.near_duplicate_pairs(prints).collect()] == [(1, 3)]
    rng = random.Random(7)
    one, two = ([(rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)] for n in (12, 20))
    edges = spark.createDataFrame([*one, *((a + 100, b + 100) for a, b in two)], EDGES)
    nodes = ids(spark, 12).unionByName(spark.range(100, 120).select("id", F.lit("B").alias("crawl_id")))
    rank = {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges, iterations=6, tolerance=0).collect()}
    assert [rank[i] for i in range(12)] == pytest.approx(pagerank_loop(12, one, 6)) and [rank[i + 100] for i in range(20)] == pytest.approx(pagerank_loop(20, two, 6))
    both = {r["id"]: (r["hub"], r["authority"]) for r in graph.hits(nodes, edges, iterations=10, tolerance=0).collect()}
    alone = {r["id"]: (r["hub"], r["authority"]) for r in graph.hits(ids(spark, 12), spark.createDataFrame(one, EDGES), iterations=10, tolerance=0).collect()}
    assert all(both[i] == pytest.approx(alone[i]) for i in range(12)) and sum(a for i, (_, a) in both.items() if i >= 100) == pytest.approx(1)


def test_near_duplicate_prints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(52) for _ in range(6)]
    rows = []
    for k in range(400):
        x = base[k % 6]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 7])):
            x ^= 1 << rng.randrange(52)
        rows.append((k, f"{(k % 2) << 52 | x:016x}", rng.choice(["same", f"c{k}"])))
    rows += [(k, s, c) for k, s, c in ((500, "f" * 16, "z"), (501, "f" * 16, "z"), (502, "e" * 16, None), (503, "e" * 16, None))]
    pages = spark.createDataFrame(rows, "id long, simhash string, content_hash string").selectExpr("*", "'x' AS normalized_url", "true AS indexable", "80 AS word_count")
    content = lambda s: {(c if c is not None else i) for i, t, c in rows if t == s}
    every = sorted({s for _, s, _ in rows})
    gap = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = {(a, b): gap(a, b) for a in every for b in every if a <= b and a[:3] == b[:3] and gap(a, b) <= 6 and (a < b or len(content(a)) > 1)}
    got = {(r["simhash_a"], r["simhash_b"]): r["distance"] for r in rules.near_duplicate_prints(pages).collect()}
    assert got == want and len(want) > 300
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1][:3] == b[1][:3] and gap(a[1], b[1]) <= 6 and (a[2] is None or b[2] is None or a[2] != b[2])}
    assert {(r["id_a"], r["id_b"]) for r in rules.near_duplicate_pairs(pages).collect()} == pairs


def test_positions_missing_and_roots(spark):
    rows = spark.createDataFrame([("a", None, 9, 0), ("a", 3.0, 9, 1), ("b", None, 9, 2)], "query string, position double, impressions long, input_order int")
    assert {r["normalized"]: r["input_order"] for r in keywords.best_per_query(rows).collect()} == {"a": 1, "b": 2}
    tree = spark.createDataFrame([(1, None), (2, None), (3, 1), (4, 1), (5, None)], "id long, parent_id long")
    ranks = spark.createDataFrame([(3, 0.1), (4, 0.9)], "id long, rank double")
    shown = {r["id"]: (r["visible"], r["hidden_children"]) for r in trees.pruned(tree, ranks, most=1).collect()}
    assert shown == {1: (True, 1), 2: (True, 0), 5: (True, 0), 3: (False, 0), 4: (True, 0)}
    plan = trees.pruned(tree, ranks)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(parent_id" in plan.lower()  # roots and orphans take no part in the window


def test_louvain_of_two_crawls(spark):
    clique = [(a, b) for k in (0, 5) for a in range(k, k + 5) for b in range(k, k + 5) if a != b] + [(4, 5)]
    nodes = ids(spark, 10).unionByName(spark.range(100, 103).select("id", F.lit("B").alias("crawl_id")))
    found = {r["id"]: r for r in graph.louvain(nodes, spark.createDataFrame([*clique, (100, 101)], EDGES)).collect()}
    assert len(found) == 13 and len({found[i]["community"] for i in range(4)}) == 1 and found[0]["modularity"] > 0.4
    assert found[100]["community"] == found[101]["community"] != found[102]["community"]
    inside = {i: found[i]["community"] for i in range(10)}
    pairs = {tuple(sorted(e)) for e in clique}
    degree = {i: sum(i in p for p in pairs) for i in range(10)}
    q = sum(inside[a] == inside[b] for a, b in pairs) / len(pairs) - sum((sum(d for i, d in degree.items() if inside[i] == c) / (2 * len(pairs))) ** 2 for c in set(inside.values()))
    assert found[0]["modularity"] == pytest.approx(q)


def test_compare_needs_one_project(spark, sf):
    crawls = spark.createDataFrame([("A", 1), ("B", 2)], "id string, project_id int")
    pages = crawl_pages(spark, sf)
    with pytest.raises(ValueError, match="one project"):
        compare.compare_crawls("A", "B", crawls, pages, pages, pages)
