"""Whole analyses: a crawl over recorded responses level by level, its analysis, the audit's context and the report."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, kept
from ..functions.reports import audit_report
from ..functions.resources import classify
from ..functions.seo import crawl_failed, geo_signals, indexability, is_nofollow
from ..functions.text import match_pattern, with_simhash
from ..functions.urls import directory_of, is_same_site, normalize_url, url_hash
from ..operators import graph, inventory, links, rules, sinks, stats
from ..sources.html import parse_pages
from ..sources.robots import allowed_urls
from . import crawl_document


def _wanted(url: Column, include: Iterable[str], exclude: Iterable[str]) -> Column:
    yes = reduce(Column.__or__, [match_pattern(url, p) for p in include], F.lit(False)) if include else F.lit(True)
    return yes & ~reduce(Column.__or__, [match_pattern(url, p) for p in exclude], F.lit(False))


def _blocked(answered: DataFrame, robots: DataFrame, agent: str, columns: list[str]) -> DataFrame:
    """answered without the responses of URLs that an agent may not ask for."""
    judged = allowed_urls(answered, robots, agent)
    none = {c: F.when(F.col("allowed"), F.col(c)) for c in columns if c not in ("url", "error_type")}
    return judged.withColumns(none | {"error_type": F.when(F.col("allowed"), F.col("error_type")).otherwise("BLOCKED_ROBOTS")}).drop("allowed", "crawl_delay")


def crawl(
    spark: SparkSession, responses: DataFrame, start: str, *, max_depth: int = 10, max_urls: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None,
    follow_subdomains: bool = False, respect_nofollow: bool = True, sitemap: DataFrame | None = None, robots: DataFrame | None = None, agent: str = "*", crawl_id: str = "A", state: str | None = None,
) -> dict[str, DataFrame]:
    """pages, links, images, schemas, hreflangs of a breadth-first crawl from start over responses.

    responses: url (normalised), final_url, status, content_type, body, redirect_chain, error_type. Each level is one join of the
    frontier to responses and one anti-join of the links found to what has been seen; sitemap has normalized_url. What robots
    (origin, text) forbids the agent counts as blocked, whatever its response. With state, a
    shared folder, the tables of each level stay there, and a crawl that broke off goes on after its last whole table.
    """
    def step(df: DataFrame, depth: int, name: str) -> DataFrame:
        return kept(df, f"{state}/{depth}/{name}") if state else cut(df, name)

    seeds = spark.createDataFrame([(start,)], "raw string").select(normalize_url(F.col("raw")).alias("url"))
    front = seeds.select("url", F.lit(0).alias("depth"), F.lit("START").alias("discovery_type"), F.lit(None).cast("string").alias("discovered_from"))
    if sitemap is not None:
        listed = sitemap.select(F.col("normalized_url").alias("url")).distinct().join(seeds, "url", "left_anti")
        front = front.unionByName(listed.select("url", F.lit(1).alias("depth"), F.lit("SITEMAP").alias("discovery_type"), F.lit(None).cast("string").alias("discovered_from")))
    seen = front = step(front, 0, "front")
    pages: list[DataFrame] = []
    edges: list[DataFrame] = []
    for depth in range(max_depth + 1):
        answered = front.join(responses.withColumnRenamed("url", "asked"), F.col("url") == F.col("asked"), "left").drop("asked")
        answered = _blocked(answered, robots, agent, responses.columns) if robots is not None else answered
        kind = classify(F.col("url"), F.col("final_url"), F.col("status"), F.col("content_type"), F.col("error_type"), F.col("redirect_chain"))
        read = answered.withColumn("kind", kind)
        read = read.withColumn("html", F.when(F.col("kind.is_html_document"), F.col("body"))).drop("body")
        parsed = step(parse_pages(read), depth, "parsed")
        pages.append(parsed)
        found = parsed.select("url", F.col("parsed.meta_robots").alias("robots"), F.posexplode("parsed.links").alias("n", "l"))
        found = found.select("url", "robots", "n", "l.*").withColumn("target_url", normalize_url(F.col("href"), F.col("url"))).where(F.col("target_url").isNotNull())
        inner = is_same_site(F.col("target_url"), F.lit(start), follow_subdomains)
        found = step(found.withColumn("link_type", F.when(inner, "INTERNAL").otherwise("EXTERNAL")), depth, "found")
        edges.append(found)
        if depth == max_depth:
            break
        onward = found.where((F.col("link_type") == "INTERNAL") & _wanted(F.col("target_url"), include or [], exclude or []))
        onward = onward.where(F.col("follow") & ~is_nofollow(F.col("robots"))) if respect_nofollow else onward
        fresh = onward.groupBy(F.col("target_url").alias("url")).agg(F.min("url").alias("discovered_from")).join(seen.select("url"), "url", "left_anti")
        fresh = fresh.select("url", F.lit(depth + 1).alias("depth"), F.lit("LINK").alias("discovery_type"), "discovered_from")
        if max_urls is not None:  # the crawl's own budget
            fresh = fresh.orderBy("url").limit(max(0, max_urls - seen.count()))
        front = step(fresh, depth + 1, "front")
        if front.isEmpty():
            break
        seen = step(seen.unionByName(front), depth + 1, "seen")
    return _tables(reduce(DataFrame.unionByName, pages), reduce(DataFrame.unionByName, edges), sitemap, crawl_id)


def _tables(parsed: DataFrame, edges: DataFrame, sitemap: DataFrame | None, crawl_id: str) -> dict[str, DataFrame]:
    p = F.col("parsed")
    known = sitemap.select(F.col("normalized_url").alias("url"), F.lit(True).alias("listed")).distinct() if sitemap is not None else None
    rows = parsed.join(known, "url", "left") if known is not None else parsed.withColumn("listed", F.lit(None).cast("boolean"))
    blocked = F.coalesce(F.col("error_type") == "BLOCKED_ROBOTS", F.lit(False))
    canonical = normalize_url(p["canonical"])
    reason = indexability(F.col("status"), p["meta_robots"], F.lit(None).cast("string"), canonical, F.col("url"), blocked, F.col("kind.is_html_document"), F.coalesce(~F.col("error_type").isin("UNSUPPORTED_CONTENT", "BLOCKED_ROBOTS"), F.lit(False)))
    count = lambda test: F.coalesce(F.size(F.filter(p["images"], test)), F.lit(0))
    text = lambda c, n: F.substring(c, 1, n)
    pages = rows.select(
        F.xxhash64("url").alias("id"), F.lit(crawl_id).alias("crawl_id"), text(F.col("url"), 2000).alias("normalized_url"), text(F.col("url"), 2000).alias("url"), url_hash(F.col("url")).alias("url_hash"),
        F.col("status").alias("status_code"), "content_type", "error_type", F.get("redirect_chain", F.lit(0)).alias("redirect_from"), F.col("final_url").alias("redirect_url"), "kind.resource_type", "kind.media_type", "kind.mime_type", F.col("kind.extension_mismatch").alias("mime_mismatch"),
        p["title"].alias("title"), F.length(p["title"]).alias("title_length"), p["meta_description"].alias("meta_description"), F.length(p["meta_description"]).alias("meta_description_length"), p["h1"].alias("h1"), F.coalesce(p["h1_count"], F.lit(0)).alias("h1_count"), F.coalesce(p["h2_count"], F.lit(0)).alias("h2_count"),
        p["canonical"].alias("canonical"), p["meta_robots"].alias("meta_robots"), F.coalesce(p["word_count"], F.lit(0)).alias("word_count"), p["language"].alias("language"), p["content_hash"].alias("content_hash"), p["text"].alias("text"),
        "depth", "discovery_type", "discovered_from", F.coalesce("listed", F.lit(False)).alias("in_sitemap"), text(directory_of(F.col("url")), 250).alias("directory"), reason.alias("indexability_reason"), (reason == "INDEXABLE").alias("indexable"),
        F.greatest(F.coalesce(F.size(p["images"]), F.lit(0)), F.lit(0)).alias("images_count"), F.greatest(count(lambda i: ~i["has_alt"]), F.lit(0)).alias("images_missing_alt"), F.greatest(count(lambda i: i["has_alt"] & (F.trim(i["alt"]) == "")), F.lit(0)).alias("images_decorative"),
        geo_signals(F.coalesce(F.transform(p["schemas"], lambda s: s["schema_type"]), F.array().cast("array<string>")), F.coalesce(p["has_author"], F.lit(False)), p["published_date"], p["modified_date"], F.coalesce(p["h1_count"], F.lit(0)), F.coalesce(p["h2_count"], F.lit(0)), F.coalesce(p["word_count"], F.lit(0)), F.coalesce(p["external_citations"], F.lit(0)), p["text_ratio"]).alias("geo_signals"),
        crawl_failed(F.col("error_type"), F.col("status")).alias("failed"), F.lit(None).cast("int").alias("response_time"),
    )
    pages = cut(with_simhash(pages, "id", "text").drop("text"), "pages")
    key = F.xxhash64("url")
    made = edges.select(
        F.xxhash64("url", "n").alias("id"), F.lit(crawl_id).alias("crawl_id"), key.alias("source_page_id"), text(F.col("target_url"), 2000).alias("target_url"), url_hash(F.col("target_url")).alias("target_hash"),
        text(F.col("anchor_text"), 500).alias("anchor_text"), text(F.col("rel"), 190).alias("rel"), "follow", "link_type", "n",
    )
    once = ["source_page_id", "target_hash", "anchor_text"]  # of the same links of a page the first stays
    made = made.groupBy(*once).agg(F.min_by(F.struct(*(c for c in made.columns if c not in (*once, "n"))), "n").alias("m")).select(*once, "m.*").select(*(c for c in made.columns if c != "n"))
    child = lambda field: parsed.select(key.alias("page_id"), F.col("url").alias("page_url"), F.explode(f"parsed.{field}").alias("x")).select("page_id", "x.*")
    images = child("images").withColumn("url_hash", url_hash(normalize_url(F.col("src"))))
    hreflangs = child("hreflangs").withColumn("href", normalize_url(F.col("href")))
    return {"pages": pages, "links": cut(links.resolve_targets(made, pages), "links"), "images": images, "schemas": child("schemas"), "hreflangs": hreflangs}


def analyze(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Link and graph metrics, findings and statistics of a crawl's tables."""
    edges = tables["links"]
    pages = cut(graph.with_graph_metrics(links.with_link_metrics(tables["pages"], edges), edges), "analyzed")
    found = cut(rules.all_findings(pages, edges, tables.get("images"), tables.get("schemas"), tables.get("hreflangs")), "findings")
    geo = stats.geo_stats(pages)
    out = {
        "pages": pages, "findings": found, "totals": stats.totals(pages), "statuses": stats.status_distribution(pages), "depths": stats.depth_distribution(pages), "reasons": stats.reason_distribution(pages),
        "severities": stats.severity_distribution(found), "top_issues": stats.top_issues(found), "directories": stats.directory_stats(pages), "links": stats.link_totals(edges), "resources": stats.resource_stats(pages),
        "clusters": stats.cluster_summary(pages), "cluster_inbound": stats.cluster_inbound(edges, pages), "bottlenecks": stats.top_by(pages, "betweenness"), "hubs": stats.top_by(pages, "hub_score"), "authorities": stats.top_by(pages, "authority_score"),
        "stats": stats.crawl_stats(pages, edges, found), "geo": geo, "geo_readiness": stats.geo_readiness(geo), "health": stats.seo_health(found, pages),
    }
    return out | ({"images": stats.image_stats(tables["images"], pages)} if "images" in tables else {})


def audit_context(pages: DataFrame, edges: DataFrame, found: DataFrame, schemas: DataFrame | None = None) -> dict[str, DataFrame]:
    """What an audit is written from: the leading and the troubled pages, repeated texts, samples of findings."""
    out = {
        "top_pages": inventory.top_pages(pages, 20), "low_inlinks": inventory.low_inlink_pages(pages, 1, 25), "deep": inventory.deep_pages(pages, 5, 25), "broken": inventory.TOOLS["getBrokenLinks"](pages, edges, found, 25),
        "redirects": inventory.redirects(pages, 20), "duplicate_titles": inventory.duplicate_values(pages, "title"), "duplicate_descriptions": inventory.duplicate_values(pages, "meta_description"),
        "canonicalized": inventory.canonicalized(pages, 20), "orphans": inventory.orphan_pages(pages, 25), "samples": inventory.issue_samples(found),
    }
    return out | ({"schemas": inventory.schema_coverage(schemas, pages)} if schemas is not None else {})


def crawl_report(title: str, analysis: dict[str, DataFrame], meta: DataFrame | None = None) -> str:
    """The crawl's document in Markdown."""
    return crawl_document.to_markdown(title, crawl_document.document_rows(analysis, meta))


def comparison_report(title: str, compared: dict[str, DataFrame]) -> str:
    """The report on two crawls (compare_crawls()) in Markdown."""
    heads = [("Changes", "counts"), ("Metrics", "metrics"), ("New URLs", "added"), ("Gone URLs", "removed"), ("Status", "status_changes"), ("Indexability", "indexability_changes"), ("Issues", "issue_deltas")]
    return sinks.render_markdown(title, [(head, compared[key]) for head, key in heads if key in compared])


def audit_document(title: str, reports: DataFrame, text: str = "output") -> str:
    """A model's latest whole audit report (the first row that has one) in Markdown."""
    rows = reports.select(audit_report(F.col(text)).alias("r")).where("r is not null").select("r.*").limit(1)
    one = lambda field: rows.select(F.explode(field).alias("x")).select("x.*")
    blocks = [("Summary", rows.select("summary", "score")), ("Critical", one("criticalIssues").select("title", "impact", "evidence")), ("High priority", one("highPriorityIssues").select("title", "impact", "evidence"))]
    blocks += [("Recommendations", one("recommendations").orderBy("priority")), ("Order", rows.select(F.explode("implementationOrder").alias("step")))]
    return sinks.render_markdown(title, blocks)
