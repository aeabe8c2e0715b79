"""Link tables: resolution of targets, in- and out-link counts, broken links and images, link exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with target_page_id filled from the page of the same crawl and URL hash."""
    known = pages.select("crawl_id", F.col("url_hash").alias("target_hash"), F.col("id").alias("__id"))
    given = F.col("target_page_id") if "target_page_id" in links.columns else F.lit(None).cast("long")
    joined = links.join(known, ["crawl_id", "target_hash"], "left").withColumn("__target", F.coalesce(given, "__id"))
    return joined.drop("target_page_id", "__id").withColumnRenamed("__target", "target_page_id")


def inlink_counts(links: DataFrame) -> DataFrame:
    """page id, internal_inlinks, unique_inlinks; links to oneself and repeated anchors count."""
    inner = links.where((F.col("link_type") == "INTERNAL") & F.col("target_page_id").isNotNull())
    return inner.groupBy(F.col("target_page_id").alias("id")).agg(F.count("*").alias("internal_inlinks"), F.count_distinct("source_page_id").alias("unique_inlinks"))


def outlink_counts(links: DataFrame) -> DataFrame:
    internal = F.col("link_type") == "INTERNAL"
    return links.groupBy(F.col("source_page_id").alias("id")).agg(
        F.count_if(internal).alias("internal_outlinks"),
        F.count_distinct(F.when(internal, F.col("target_hash"))).alias("unique_outlinks"),
        F.count_if(F.col("link_type") == "EXTERNAL").alias("external_outlinks"),
    )


LINK_COUNTS = ["internal_inlinks", "unique_inlinks", "internal_outlinks", "unique_outlinks", "external_outlinks"]


def with_link_metrics(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages with the five link counts and potential_orphan."""
    base = pages.drop(*LINK_COUNTS, "potential_orphan")
    joined = base.join(inlink_counts(links), "id", "left").join(outlink_counts(links), "id", "left").fillna(0, LINK_COUNTS)
    orphan = F.col("in_sitemap") & (F.col("internal_inlinks") == 0) & (F.col("discovery_type") != "START")
    return joined.withColumn("potential_orphan", orphan)


def broken_internal_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """source and target of internal links to pages that answered 400 or more; no answer is not broken here."""
    bad = pages.where(F.col("status_code") >= 400).select(F.col("id").alias("target_page_id"), F.col("normalized_url").alias("target_url"), "status_code")
    source = pages.select(F.col("id").alias("source_page_id"), F.col("normalized_url").alias("source_url"))
    inner = links.where(F.col("link_type") == "INTERNAL").select("source_page_id", "target_page_id", F.substring("anchor_text", 1, 120).alias("anchor"))
    return inner.join(bad, "target_page_id").join(source, "source_page_id")


def broken_images(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Page, image URL, status and appearances of images whose own URL was crawled and failed or gave no answer."""
    html = pages.where(F.col("resource_type") == "HTML_PAGE").select(F.col("id").alias("page_id"), "crawl_id", F.col("normalized_url").alias("source_url"))
    bad = pages.where((F.col("status_code") >= 400) | F.col("status_code").isNull()).select("crawl_id", "url_hash", F.col("normalized_url").alias("image_url"), "status_code")
    used = images.where(F.col("url_hash").isNotNull()).select("page_id", "url_hash").join(html, "page_id")
    return used.join(bad, ["crawl_id", "url_hash"]).groupBy("page_id", "source_url", "image_url", "status_code").agg(F.count("*").alias("appearances"))


def image_statuses(images: DataFrame, pages: DataFrame) -> DataFrame:
    """images with the status of their own URL where their page's crawl fetched it; of several answers, the lowest status."""
    known = pages.groupBy("crawl_id", "url_hash").agg(F.min("status_code").alias("image_status"))
    own = images if "crawl_id" in images.columns else images.join(pages.select(F.col("id").alias("page_id"), "crawl_id"), "page_id", "left")
    return own.join(known, ["crawl_id", "url_hash"], "left").select(*images.columns, "image_status")


def link_export(links: DataFrame, pages: DataFrame, link_type: str) -> DataFrame:
    """Source URL, target URL, target status, anchor, rel, follow."""
    source = pages.select(F.col("id").alias("source_page_id"), F.col("normalized_url").alias("source_url"))
    target = pages.select(F.col("id").alias("target_page_id"), F.col("status_code").alias("target_status"))
    rows = links.where(F.col("link_type") == link_type).join(source, "source_page_id").join(target, "target_page_id", "left")
    return rows.select("source_url", "target_url", "target_status", "anchor_text", "rel", "follow")


def distinct_edges(links: DataFrame) -> DataFrame:
    """One row for each pair of different pages, with the first anchor (by id)."""
    inner = links.where(F.col("target_page_id").isNotNull() & (F.col("source_page_id") != F.col("target_page_id")))
    return inner.groupBy(F.col("source_page_id").alias("src"), F.col("target_page_id").alias("dst")).agg(F.min_by("anchor_text", "id").alias("anchor_text"))


def distinct_page_links(links: DataFrame) -> DataFrame:
    """One link for each page, target and anchor."""
    return links.groupBy("source_page_id", "target_hash", "anchor_text").agg(F.min("id").alias("id"))


def edges_within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Internal followed links with both ends among nodes (id); parallel links stay."""
    inner = links.where((F.col("link_type") == "INTERNAL") & F.col("follow") & F.col("target_page_id").isNotNull())
    edges = inner.select(F.col("source_page_id").alias("src"), F.col("target_page_id").alias("dst"))
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def inter_group_links(links: DataFrame, pages: DataFrame, group: str | Column) -> DataFrame:
    """Number of links from each group of pages to each other group."""
    key = F.col(group) if isinstance(group, str) else group
    by = pages.select("id", key.alias("__g")).where(F.col("__g").isNotNull())
    inner = links.where((F.col("link_type") == "INTERNAL") & F.col("target_page_id").isNotNull())
    joined = inner.join(by.select(F.col("id").alias("source_page_id"), F.col("__g").alias("from_group")), "source_page_id").join(by.select(F.col("id").alias("target_page_id"), F.col("__g").alias("to_group")), "target_page_id")
    return joined.groupBy("from_group", "to_group").agg(F.count("*").alias("links"))


def should_follow(links: DataFrame, depth: Column, max_depth: int, page_nofollow: Column, respect_nofollow: bool = True) -> DataFrame:
    """Internal links that the crawl goes after from a page of this depth."""
    ok = (F.col("link_type") == "INTERNAL") & (depth < max_depth)
    return links.where(ok & F.col("follow") & ~page_nofollow) if respect_nofollow else links.where(ok)
