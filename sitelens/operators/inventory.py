"""Filtered, sorted and paged inventories of pages and findings, and read-only query tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.seo import severity_rank
from .links import broken_internal_links, distinct_edges
from .stats import depth_distribution, directory_breakdown, is_page, link_totals, reason_distribution, seo_health, severity_distribution, status_distribution, top_issues, totals

SORTABLE = ["internal_page_rank", "normalized_url", "status_code", "depth", "word_count", "internal_inlinks", "internal_outlinks", "response_time", "title_length", "betweenness", "authority_score"]
COLUMNS = [
    "id", "normalized_url", "status_code", "resource_type", "media_type", "content_type", "title", "title_length", "meta_description", "meta_description_length", "h1", "h1_count", "canonical", "meta_robots", "indexable",
    "indexability_reason", "word_count", "depth", "internal_inlinks", "internal_outlinks", "external_outlinks", "internal_page_rank", "response_time", "error_type", "potential_orphan",
]


def clamp(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


def page_filter(pages: DataFrame, *, status: str | None = None, kind: str | None = None, search: str | None = None, min_depth: int | None = None, max_depth: int | None = None, min_inlinks: int | None = None, max_inlinks: int | None = None, **equal) -> DataFrame:
    """Filters of the inventory; an unknown status class filters nothing, other keywords compare columns."""
    out = pages
    if status in ("2xx", "3xx", "4xx", "5xx", "error"):
        ranges = {"2xx": (200, 299), "3xx": (300, 399), "4xx": (400, 499), "5xx": (500, 599)}
        out = out.where(F.col("status_code").isNull() if status == "error" else F.col("status_code").between(*ranges[status]))
    if kind in ("pages", "assets"):
        out = out.where(is_page() if kind == "pages" else ~is_page())
    if search:
        out = out.where(F.lower("normalized_url").contains(search.lower()) | F.lower("title").contains(search.lower()))
    for column, low, high in (("depth", min_depth, max_depth), ("internal_inlinks", min_inlinks, max_inlinks)):
        out = out.where(F.col(column) >= low) if low is not None else out
        out = out.where(F.col(column) <= high) if high is not None else out
    for column, value in equal.items():
        out = out.where(F.col(column) == value) if value is not None else out
    return out


def with_issue(pages: DataFrame, findings: DataFrame, code: str) -> DataFrame:
    return pages.join(findings.where(F.col("code") == code).select(F.col("page_id").alias("id")), "id", "left_semi")


def page_inventory(pages: DataFrame, *, sort: str = "internal_page_rank", descending: bool = True, page: int = 1, per_page: int = 50, **filters) -> DataFrame:
    """One page of the filtered inventory, by a permitted column and then by id."""
    sort = sort if sort in SORTABLE else "internal_page_rank"
    size = clamp(per_page, 10, 200)
    order = F.col(sort).desc() if descending else F.col(sort).asc()
    rows = page_filter(pages, **filters).orderBy(order, "id")
    rows = rows.offset((page - 1) * size) if page > 1 else rows
    return rows.limit(size).select(*[c for c in COLUMNS if c in pages.columns])


def page_count(pages: DataFrame, per_page: int = 50, **filters) -> DataFrame:
    size = clamp(per_page, 10, 200)
    return page_filter(pages, **filters).agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def issue_dashboard(findings: DataFrame) -> DataFrame:
    """Findings by code, worst severity and largest number first."""
    rows = findings.groupBy("code", "severity", "title").agg(F.count("*").alias("count"))
    return rows.orderBy(severity_rank(F.col("severity")).desc(), F.desc("count"), "code")


def issues_of_page(findings: DataFrame, page_id: int) -> DataFrame:
    return findings.where(F.col("page_id") == page_id).orderBy(severity_rank(F.col("severity")), "code")


def issue_samples(findings: DataFrame, codes: int = 8, urls: int = 5) -> DataFrame:
    """The first URLs of the most frequent codes."""
    top = findings.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(codes)
    w = W.Window.partitionBy("code").orderBy("url", "page_id")
    return findings.join(F.broadcast(top), "code").withColumn("place", F.row_number().over(w)).where(F.col("place") <= urls).select("code", "place", "url")  # codes rows


def issues_per_page(pages: DataFrame, findings: DataFrame) -> DataFrame:
    return pages.join(findings.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("issues")), "id", "left").fillna(0, ["issues"])


def find_page(pages: DataFrame, url: str) -> DataFrame:
    """The page with the URL, or else the first whose URL holds it."""
    hit = F.col("normalized_url") == url
    return pages.where(hit | F.col("normalized_url").contains(url)).orderBy(hit.desc(), "id").limit(1)


def top_pages(pages: DataFrame, limit: int = 20) -> DataFrame:
    return pages.where("indexable").orderBy(F.desc("internal_page_rank"), "id").limit(clamp(limit, 1, 100))


def low_inlink_pages(pages: DataFrame, max_inlinks: int = 1, limit: int = 25) -> DataFrame:
    own = pages.where(F.col("indexable") & (F.col("internal_inlinks") <= max_inlinks) & (F.col("depth") > 0))
    return own.orderBy("internal_inlinks", "id").limit(clamp(limit, 1, 100))


def deep_pages(pages: DataFrame, min_depth: int = 5, limit: int = 25) -> DataFrame:
    return pages.where(is_page() & (F.col("depth") >= min_depth)).orderBy(F.desc("depth"), "id").limit(clamp(limit, 1, 100))


def redirects(pages: DataFrame, limit: int = 20) -> DataFrame:
    return pages.where(F.col("status_code").between(300, 399)).orderBy(F.desc("internal_inlinks"), "id").limit(clamp(limit, 1, 100))


def orphan_pages(pages: DataFrame, limit: int = 25) -> DataFrame:
    return pages.where("potential_orphan").orderBy("id").limit(limit)


def canonicalized(pages: DataFrame, limit: int = 20) -> DataFrame:
    return pages.where(F.col("indexability_reason") == "CANONICALIZED").orderBy("id").limit(limit)


def duplicate_values(pages: DataFrame, column: str, most: int = 15, prefix: int = 150) -> DataFrame:
    own = pages.where(F.col("indexable") & (F.col(column) != ""))
    return own.groupBy(F.substring(column, 1, prefix).alias("value")).agg(F.count("*").alias("pages")).where("pages > 1").orderBy(F.desc("pages"), "value").limit(most)


def schema_coverage(schemas: DataFrame, pages: DataFrame, most: int = 20) -> DataFrame:
    own = schemas.where(F.col("schema_type").isNotNull()).join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi")
    return own.groupBy("schema_type").agg(F.count_distinct("page_id").alias("pages")).orderBy(F.desc("pages"), "schema_type").limit(most)


def links_to(pages: DataFrame, links: DataFrame, page_id: int, limit: int = 200) -> DataFrame:
    source = pages.select(F.col("id").alias("source_page_id"), F.col("normalized_url").alias("source_url"), "internal_page_rank")
    return links.where(F.col("target_page_id") == page_id).join(source, "source_page_id").orderBy(F.desc("internal_page_rank"), "id").limit(limit)


def links_from(pages: DataFrame, links: DataFrame, page_id: int, limit: int = 500) -> DataFrame:
    target = pages.select(F.col("id").alias("target_page_id"), F.col("normalized_url").alias("to_url"), "status_code")
    return links.where(F.col("source_page_id") == page_id).join(target, "target_page_id", "left").orderBy("id").limit(limit)


def subgraph(pages: DataFrame, links: DataFrame, *, limit: int = 500, **filters) -> tuple[DataFrame, DataFrame]:
    """Nodes (most rank, then most inlinks first) and the distinct edges among them, at most twelve for each node of the limit."""
    size = clamp(limit, 10, 20_000)
    nodes = page_filter(pages, **filters).orderBy(F.desc("internal_page_rank"), F.desc("internal_inlinks"), "id").limit(size)
    edges = distinct_edges(links).join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, edges.orderBy("src", "dst").limit(12 * size)


def load_pages(pages: DataFrame, limit: int, **filters) -> tuple[DataFrame, DataFrame]:
    """The first pages of a tree or graph (least depth, then most rank), and one row of total, rendered and truncated."""
    own = page_filter(pages, **filters)
    rows = own.orderBy("depth", F.desc_nulls_last("internal_page_rank"), "id").limit(limit)
    return rows, own.agg(F.count("*").alias("total")).select("total", F.least("total", F.lit(limit)).cast("long").alias("rendered"), (F.col("total") > limit).alias("truncated"))


def page_by_id(pages: DataFrame, page_id: int) -> DataFrame:
    return pages.where(F.col("id") == page_id)


def page_details(page_id: int, pages: DataFrame, links: DataFrame, findings: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """A page's row, its findings, inlinks with sources, outlinks with their targets' status, and its rows of each child table (page_id)."""
    shown = {name: df.where(F.col("page_id") == page_id) for name, df in children.items()}
    return {"page": page_by_id(pages, page_id), "issues": issues_of_page(findings, page_id), "inlinks": links_to(pages, links, page_id), "outlinks": links_from(pages, links, page_id)} | shown


def report_list(reports: DataFrame, crawls: DataFrame, project_id: object, *, kind: str | None = None, most: int = 50) -> DataFrame:
    """The latest reports of a project's crawls without error, with the score out of their JSON output."""
    own = reports.where(F.col("error").isNull() & (F.col("type") == kind if kind else F.lit(True)))
    of = crawls.where(F.col("project_id") == project_id).select(F.col("id").alias("crawl_id"), "start_url", "crawled_urls", "completed_at")
    score = F.get_json_object("output", "$.score").try_cast("double")
    return own.join(of, "crawl_id").orderBy(F.desc("created_at"), F.desc("id")).limit(most).select("id", "model", "type", "created_at", "crawl_id", "start_url", "crawled_urls", "completed_at", score.alias("score"))


def owned_by(pages: DataFrame, crawls: DataFrame, projects: DataFrame, owners: list[str]) -> DataFrame:
    """Pages of crawls of projects that belong to one of the owners."""
    mine = projects.where(F.col("owner_id").isin(owners)).select(F.col("id").alias("project_id"))
    own = crawls.join(mine, "project_id", "left_semi").select(F.col("id").alias("crawl_id"))
    return pages.join(own, "crawl_id", "left_semi")


def latest_per_parent(children: DataFrame, parent: str, order: Column) -> DataFrame:
    """The latest child of each parent and the number of children, by aggregation."""
    whole = F.struct(*(F.col(c) for c in children.columns))
    return children.groupBy(parent).agg(F.max_by(whole, order).alias("__x"), F.count("*").alias("children")).select("__x.*", "children")


def workspace_totals(projects: DataFrame, crawls: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    rows = [df.agg(F.count("*").alias("count")).select(F.lit(k).alias("what"), "count") for k, df in (("projects", projects), ("crawls", crawls), ("pages", pages), ("issues", findings))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def latest_log(events: DataFrame, order: str, most: int, *, key: str = "id") -> DataFrame:
    return events.orderBy(F.desc(order), F.desc(key)).limit(most)


def crawl_summary(pages: DataFrame, links: DataFrame, findings: DataFrame) -> DataFrame:
    """part, key, value: totals, statuses, depths, reasons, severities, leading issues and health of a crawl, as one table."""
    one = lambda part, df: df.select(F.lit(part).alias("part"), F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in df.columns))).alias("x")).select("part", "x.*")
    by = lambda part, df: df.select(F.lit(part).alias("part"), F.col(df.columns[0]).cast("string").alias("key"), F.col("count").cast("double").alias("value"))
    parts = [
        one("totals", totals(pages)), one("links", link_totals(links)), one("health", seo_health(findings, pages)), by("status", status_distribution(pages)), by("depth", depth_distribution(pages)),
        by("reason", reason_distribution(pages)), by("severity", severity_distribution(findings)), by("issue", top_issues(findings).select("code", "count")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Named read-only tools: (pages, links, findings, **arguments) -> rows.
TOOLS = {
    "getPagesByIssue": lambda p, li, f, code, limit=25: with_issue(p, f, code).orderBy("id").limit(clamp(limit, 1, 100)),
    "getTopPagesByPageRank": lambda p, li, f, limit=20: top_pages(p, limit),
    "getLowInlinkPages": lambda p, li, f, max_inlinks=1, limit=25: low_inlink_pages(p, max_inlinks, limit),
    "getDeepPages": lambda p, li, f, min_depth=5, limit=25: deep_pages(p, min_depth, limit),
    "getBrokenLinks": lambda p, li, f, limit=25: broken_internal_links(li, p).orderBy("source_page_id", "target_page_id").limit(clamp(limit, 1, 100)),
    "getRedirects": lambda p, li, f, limit=20: redirects(p, limit),
    "getPageDetails": lambda p, li, f, url: find_page(p, url),
    "getLinksToPage": lambda p, li, f, page_id, limit=50: links_to(p, li, page_id, limit),
    "getLinksFromPage": lambda p, li, f, page_id, limit=50: links_from(p, li, page_id, limit),
    "getDirectoryBreakdown": lambda p, li, f: directory_breakdown(p),
    "getCrawlSummary": lambda p, li, f: crawl_summary(p, li, f),
}
