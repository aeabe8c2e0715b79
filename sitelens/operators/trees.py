"""Site trees as rows (node_id, parent_id, ...): by path, by clicks, by inlinks, by community and by section."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.lineage import cut, discard
from ..functions.urls import is_system_path, path_only, segments, silo_key, slug_key
from .inventory import clamp, load_pages

MAX_CHILDREN = 40
#: Levels of a search whose tables are put together.
TOGETHER = 12


def path_tree(pages: DataFrame) -> DataFrame:
    """A row for each path prefix: node_id, parent_id, depth, label, page_id (of the page at that very path, if any), pages below."""
    parts = segments(F.col("normalized_url"))
    at = F.concat(F.lit("/"), F.array_join(parts, "/"))
    own = pages.select("id", at.alias("node_id"), parts.alias("parts"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.struct(F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, n), "/")).alias("node_id"), n.alias("depth"), F.when(n > 0, F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, F.greatest(n - 1, F.lit(0))), "/"))).alias("parent_id"), F.when(n == 0, "/").otherwise(F.get("parts", n - 1)).alias("label")))
    nodes = own.select("id", F.explode(prefixes).alias("p")).groupBy("p.node_id").agg(F.first("p.parent_id").alias("parent_id"), F.first("p.depth").cast("int").alias("depth"), F.first("p.label").alias("label"), F.count("*").alias("pages"))
    return nodes.join(own.groupBy("node_id").agg(F.min("id").alias("page_id")), "node_id", "left")


def _positions(reached: DataFrame, ranks: DataFrame) -> DataFrame:
    """id, parent_id, pos: the order in which a queue would hold the nodes that their parents (at place ppos of the level above) reach first.

    Siblings are numbered within their parent (rank, then id), parents' children are summed up in the order of the parents, first by
    buckets of places and then within them. So a row is of one size at every depth, and no task holds a level.
    """
    siblings = W.Window.partitionBy("ppos").orderBy(-F.coalesce("rank", F.lit(0.0)), "id")
    rows = reached.join(ranks, "id", "left").withColumn("k", F.row_number().over(siblings))
    parents = rows.groupBy("ppos").agg(F.count("*").alias("n")).withColumn("bucket", F.shiftright("ppos", 12))
    before = W.Window.orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    buckets = parents.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.Window.partitionBy("bucket").orderBy("ppos").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = parents.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(buckets, "bucket")
    placed = rows.join(offsets.select("ppos", (F.col("first") + F.col("base")).alias("offset")), "ppos")
    return placed.select("id", "parent_id", (F.col("offset") + F.col("k") - 1).alias("pos"))


def _bfs(start: DataFrame, edges: DataFrame, ranks: DataFrame, levels: int | None = None) -> DataFrame:
    """id, parent_id, depth from start (id) over edges (src, dst), one round for each level until none is left, or for so many levels.

    A node's parent is the first in visiting order that reaches it. A node of the last level knows its place in that order; what has
    been seen is a table for each level, put together now and then.
    """
    front = cut(start.select("id", F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("pos")), "front")
    done = front.select("id", "parent_id", F.lit(0).alias("depth"))
    tables, depth = [front], 0
    while levels is None or depth < levels:
        depth += 1
        reached = edges.join(front.select(F.col("id").alias("src"), "pos"), "src").join(done.select(F.col("id").alias("dst")), "dst", "left_anti")
        best = reached.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("pos", "src")).alias("m"))
        front = cut(_positions(best.select("id", F.col("m.src").alias("parent_id"), F.col("m.pos").alias("ppos")), ranks), "front")
        tables.append(front)
        if front.isEmpty():
            break
        done = done.unionByName(front.select("id", "parent_id", F.lit(depth).alias("depth")))
        if len(tables) > TOGETHER:
            done = cut(done, "seen")
            discard(*tables[:-1])
            tables = [done, front]
    return done


def link_tree(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Click tree from the home page (path /, by id; else the page with most rank), however deep: id, parent_id, depth, is_orphan."""
    home = pages.select("id", (path_only(F.col("normalized_url")).isin("", "/")).alias("home"), F.coalesce("internal_page_rank", F.lit(0.0)).alias("rank"))
    root = home.orderBy(F.desc("home"), F.when(F.col("home"), 0.0).otherwise(-F.col("rank")), "id").limit(1).select("id")
    simple = edges.where("src <> dst").select("src", "dst").distinct()
    tree = _bfs(root, simple, home.select("id", "rank"))
    return pages.select("id").join(tree, "id", "left").withColumn("is_orphan", F.col("depth").isNull())


def cross_links(tree: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Links between different pages that are no edge of the tree; with most, the first by source and target."""
    own = tree.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    rest = edges.where("src <> dst").join(own, ["src", "dst"], "left_anti")
    return rest.orderBy("src", "dst").limit(most) if most else rest


def inlink_tree(pages: DataFrame, links: DataFrame, focus: int, *, levels: int = 4) -> DataFrame:
    """Who links to a page, and who links to these: id, parent_id, depth, anchor_text."""
    inner = links.where((F.col("link_type") == "INTERNAL") & F.col("target_page_id").isNotNull() & (F.col("source_page_id") != F.col("target_page_id")))
    back = inner.groupBy(F.col("target_page_id").alias("src"), F.col("source_page_id").alias("dst")).agg(F.min_by("anchor_text", "id").alias("anchor_text"))
    ranks = pages.select("id", F.coalesce("internal_page_rank", F.lit(0.0)).alias("rank"))
    tree = _bfs(pages.where(F.col("id") == focus).select("id"), back.select("src", "dst"), ranks, levels)
    return tree.join(back.select(F.col("src").alias("parent_id"), F.col("dst").alias("id"), "anchor_text"), ["parent_id", "id"], "left")


def cluster_tree(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Communities: pages, mean depth, most frequent directory, page with most rank, links from other communities."""
    own = pages.where(F.col("cluster_id").isNotNull())
    summary = own.groupBy("cluster_id").agg(
        F.count("*").alias("pages"), F.round(F.avg("depth"), 1).alias("avg_depth"), F.max_by("normalized_url", F.struct(F.coalesce("internal_page_rank", F.lit(0.0)), -F.col("id"))).alias("top_url"),
    )
    directories = own.groupBy("cluster_id", "directory").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.max_by("directory", F.struct("n", "directory")).alias("directory"))
    by = own.select("id", "cluster_id")
    inner = links.where((F.col("link_type") == "INTERNAL") & F.col("target_page_id").isNotNull())
    crossing = inner.join(by.select(F.col("id").alias("source_page_id"), F.col("cluster_id").alias("c")), "source_page_id").join(by.select(F.col("id").alias("target_page_id"), "cluster_id"), "target_page_id")
    inbound = crossing.where(F.col("c") != F.col("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("inbound_links"))
    return summary.join(directories, "cluster_id").join(inbound, "cluster_id", "left").fillna(0, ["inbound_links"])


def silo_column(pages: DataFrame, *, depth: int = 1, grouping: str = "auto", flat_share: float = 0.7) -> tuple[Column, bool]:
    """Section of each page and whether the site is flat (over 70 % of its pages at the root); flat sites group by slug."""
    url = F.col("normalized_url")
    flat = False
    if grouping == "auto":
        n = pages.agg(F.count("*").alias("n"), F.count_if(F.size(segments(url)) <= 1).alias("root")).first()
        flat = bool(n["n"]) and n["root"] / n["n"] > flat_share
    return slug_key(url) if flat or grouping == "slug" else silo_key(url, depth), flat


def silos(pages: DataFrame, links: DataFrame, *, depth: int = 1, grouping: str = "auto") -> DataFrame:
    """Sections: pages, indexable pages, orphans, depth, rank and its share, links within, out of and into it, cohesion, hub."""
    own = pages.where(~is_system_path(F.col("normalized_url")))
    key, flat = silo_column(own, depth=depth, grouping=grouping)
    keyed = own.withColumn("silo", key)
    rank = F.coalesce("internal_page_rank", F.lit(0.0))
    summary = keyed.groupBy("silo").agg(
        F.count("*").alias("pages"), F.count_if("indexable").alias("indexable_pages"), F.count_if("potential_orphan").alias("orphans"), F.avg("depth").alias("avg_depth"),
        F.sum(rank).alias("page_rank"), F.max_by("normalized_url", F.struct("internal_inlinks", rank, -F.col("id"))).alias("hub_url"),
    )
    flow = silo_flows(keyed, links)
    within = flow.groupBy(F.col("from_silo").alias("silo")).agg(F.sum(F.when(F.col("from_silo") == F.col("to_silo"), F.col("links")).otherwise(0)).alias("internal_links"), F.sum(F.when(F.col("from_silo") != F.col("to_silo"), F.col("links")).otherwise(0)).alias("outbound_links"))
    into = flow.where("from_silo <> to_silo").groupBy(F.col("to_silo").alias("silo")).agg(F.sum("links").alias("inbound_links"))
    joined = summary.join(within, "silo", "left").join(into, "silo", "left").fillna(0, ["internal_links", "outbound_links", "inbound_links"])
    sent = F.col("internal_links") + F.col("outbound_links")
    total = summary.agg(F.sum("page_rank").alias("__total"))
    out = joined.join(F.broadcast(total)).withColumn("share", F.when(F.col("__total") > 0, F.col("page_rank") / F.col("__total")).otherwise(0.0)).drop("__total")  # one row
    return out.withColumn("cohesion", F.when(sent > 0, F.col("internal_links") / sent).otherwise(0.0)).withColumn("flat_site", F.lit(flat))


def silo_flows(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """Links between sections, from keyed pages (id, silo)."""
    by = keyed.select("id", "silo")
    inner = links.where((F.col("link_type") == "INTERNAL") & F.col("target_page_id").isNotNull() & (F.col("source_page_id") != F.col("target_page_id")))
    pairs = inner.join(by.select(F.col("id").alias("source_page_id"), F.col("silo").alias("from_silo")), "source_page_id").join(by.select(F.col("id").alias("target_page_id"), F.col("silo").alias("to_silo")), "target_page_id")
    return pairs.groupBy("from_silo", "to_silo").agg(F.count("*").alias("links"))


def silo_findings(summary: DataFrame, flows: DataFrame, *, least_pages: int = 3) -> DataFrame:
    """What is wrong with sections of least_pages pages or more: code, severity, silo, detail."""
    sent = F.col("internal_links") + F.col("outbound_links")
    own = summary.where(F.col("pages") >= least_pages)
    tests = [
        ("NO_HEAD", "HIGH", F.col("silo").isNotNull() & (F.col("silo") != "/") & F.col("head_url").isNull(), F.lit(None)),
        ("WEAK_HEAD", "MEDIUM", F.col("head_inlinks") < F.col("hub_inlinks"), F.col("hub_url")),
        ("LEAKING", "MEDIUM", (sent > 0) & (F.col("cohesion") < 0.5), F.round("cohesion", 4)),
        ("NOT_LINKED", "HIGH", (F.col("silo") != "/") & (F.col("inbound_links") == 0), F.lit(None)),
        ("ORPHANS", "MEDIUM", F.col("orphans") > 0, F.col("orphans")),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))) for code, severity, test, detail in tests)), lambda x: x.isNotNull())
    of_silo = own.select("silo", F.explode(found).alias("x")).select("x.code", "x.severity", "silo", "x.detail")
    leak = flows.where("from_silo <> to_silo").join(own.select(F.col("silo").alias("from_silo"), "internal_links"), "from_silo").where(F.col("links") > F.col("internal_links"))
    return of_silo.unionByName(leak.select(F.lit("FLOW").alias("code"), F.lit("LOW").alias("severity"), F.col("from_silo").alias("silo"), F.concat(F.lit("→ "), "to_silo", F.lit(": "), F.col("links").cast("string")).alias("detail")))


def silo_top_pages(keyed: DataFrame, most: int = 10) -> DataFrame:
    """The pages of each section (keyed: pages with silo) with most inlinks."""
    w = W.Window.partitionBy("silo").orderBy(F.desc_nulls_last("internal_inlinks"), F.desc_nulls_last("internal_page_rank"), "id")
    return keyed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("silo", "place", "id", "normalized_url", "internal_inlinks", "internal_page_rank")


def silo_report(pages: DataFrame, links: DataFrame, *, depth: int = 1, grouping: str = "path", most: int = 10, least_pages: int = 3) -> dict[str, DataFrame]:
    """silos, top_pages, flows between sections, findings, and one row of totals: the whole report on a site's sections."""
    own = pages.where((F.col("resource_type") == "HTML_PAGE") & ~is_system_path(F.col("normalized_url")))
    key, flat = silo_column(own, depth=depth, grouping=grouping)
    keyed = own.withColumn("silo", key)
    summary = silos(own, links, depth=depth, grouping="slug" if flat and grouping == "auto" else "path" if grouping == "auto" else grouping)
    head = F.lower(F.regexp_replace(path_only(F.col("normalized_url")), "/+$", ""))
    heads = keyed.where(head == F.lower(F.regexp_replace("silo", "/+$", ""))).groupBy("silo").agg(F.min("normalized_url").alias("head_url"), F.max("internal_inlinks").alias("head_inlinks"))
    top = keyed.groupBy("silo").agg(F.max("internal_inlinks").alias("hub_inlinks"))
    summary = summary.join(heads, "silo", "left").join(top, "silo", "left")
    flows = silo_flows(keyed, links)
    crossing = F.coalesce(F.sum(F.when(F.col("from_silo") != F.col("to_silo"), F.col("links"))), F.lit(0))
    sums = flows.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("internal_links"), crossing.alias("cross_silo_links"))
    counts = pages.agg(F.count("*").alias("total_pages")).join(F.broadcast(own.agg(F.count("*").alias("analyzed_pages")))).join(F.broadcast(sums))  # one row each
    kept = F.when(F.col("internal_links") > 0, 1 - F.col("cross_silo_links") / F.col("internal_links")).otherwise(0.0)
    totals = counts.withColumns({"cohesion": kept, "flat_site": F.lit(flat)})
    return {"silos": summary, "top_pages": silo_top_pages(keyed, most), "flows": flows, "findings": silo_findings(summary, flows, least_pages=least_pages), "totals": totals}


MODES = ["path", "link", "inlinks", "cluster", "silo"]


def build_tree(pages: DataFrame, links: DataFrame, *, mode: str = "path", limit: int = 1500, focus: int | None = None, grouping: str = "path", **filters) -> dict[str, DataFrame]:
    """tree, counts (total, rendered, truncated) and, of the click tree, cross_links: one of MODES (others: path) over filtered pages.

    At most limit pages (10 to 10,000), those nearest to the start and then with most rank, are shown. focus is the page whose
    inlinks are shown; without one it is the page with most rank.
    """
    rows, counts = load_pages(pages, clamp(limit, 10, 10_000), **filters)
    rows = cut(rows, "tree-pages")
    inner = links.where((F.col("link_type") == "INTERNAL") & F.col("target_page_id").isNotNull())
    shown = inner.join(rows.select(F.col("id").alias("source_page_id")), "source_page_id", "left_semi").join(rows.select(F.col("id").alias("target_page_id")), "target_page_id", "left_semi")
    if mode == "link":
        edges = shown.select(F.col("source_page_id").alias("src"), F.col("target_page_id").alias("dst"))
        tree = cut(link_tree(rows, edges), "tree")
        return {"tree": tree, "counts": counts, "cross_links": cross_links(tree, edges.distinct())}
    if mode == "inlinks":
        first = rows.orderBy(F.desc_nulls_last("internal_page_rank"), "id").select("id").first() if focus is None else None
        focus = first["id"] if first else focus
        tree = inlink_tree(rows, shown, focus) if focus is not None else rows.select("id").limit(0)
    elif mode == "cluster":
        tree = cluster_tree(rows, shown)
    elif mode == "silo":
        tree = silos(rows, shown, grouping=grouping)
    else:
        tree = path_tree(rows)
    return {"tree": tree, "counts": counts}


def pruned(tree: DataFrame, ranks: DataFrame, *, most: int = MAX_CHILDREN) -> DataFrame:
    """Tree rows (id, parent_id) with visible (the first children of each node by rank) and hidden_children of each node.

    Roots and orphans are always visible; they take no part in the ranking of children.
    """
    w = W.Window.partitionBy("parent_id").orderBy(F.desc_nulls_last("rank"), "id")
    below = tree.where(F.col("parent_id").isNotNull()).join(ranks, "id", "left").withColumn("visible", F.row_number().over(w) <= most).drop("rank")
    placed = below.unionByName(tree.where(F.col("parent_id").isNull()).withColumn("visible", F.lit(True)))
    hidden = placed.where("not visible").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("hidden_children"))
    return placed.join(hidden, "id", "left").fillna(0, ["hidden_children"])


def _doubled(tree: DataFrame, values: dict[str, Column], step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Tree rows (id, up: the parent) with values, after rounds in which step(now, met) works them out for twice as many levels, and up skips to twice as far."""
    most = max(1, tree.count()).bit_length() + 1
    now = cut(tree.select("id", F.col("parent_id").alias("up"), *(v.alias(c) for c, v in values.items())), "jumps")
    for _ in range(most):
        if now.where("up is not null").isEmpty():
            return now
        last, now = now, cut(step(now, now.select(F.col("id").alias("up"), F.col("up").alias("over"), *(F.col(c).alias(f"{c}_up") for c in values))), "jumps")
        discard(last)
    raise ValueError("parents go round in a circle")


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """id, size: nodes in each subtree, the node itself included, of a tree (id, parent_id) or several, however deep.

    After k rounds a node has counted what is fewer than 2^k levels below it, and points to its ancestor 2^k levels above, to which
    it then hands its count: as many rounds as the depth has binary digits, each a join and a sum.
    """

    def step(now: DataFrame, above: DataFrame) -> DataFrame:
        handed = now.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        jumped = now.join(above.select("up", "over"), "up", "left")
        return jumped.join(handed, "id", "left").select("id", F.col("over").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))

    return _doubled(tree, {"size": F.lit(1).cast("long")}, step).select("id", "size")


def roots_and_depths(tree: DataFrame) -> DataFrame:
    """id, root_id, depth (0: a root) of the nodes of a tree (id, parent_id) or several, by skipping twice as many levels each round."""

    def step(now: DataFrame, above: DataFrame) -> DataFrame:
        jumped = now.join(above, "up", "left")
        return jumped.select("id", F.col("over").alias("up"), F.coalesce("root_id_up", "root_id").alias("root_id"), (F.col("depth") + F.coalesce("depth_up", F.lit(0))).alias("depth"))

    return _doubled(tree, {"root_id": F.coalesce("parent_id", "id"), "depth": F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long")}, step).select("id", "root_id", "depth")
