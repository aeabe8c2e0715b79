"""Crawl statistics: distributions, totals, images, clusters, readiness and health, in few passes over pages, links, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.seo import SEVERITY_WEIGHTS, half_up, percent
from .links import inter_group_links

# Paths that show who is behind a site and how to reach them.
ABOUT = r"/(about|about-us|sobre|sobre-nosotros|quienes-somos|nosotros|empresa|acerca)"
CONTACT = r"/(contact|contacto|contact-us|contactar)"


def is_page(pages: DataFrame | None = None) -> Column:
    """HTML page, or older than classification."""
    return F.coalesce(F.col("resource_type"), F.lit("HTML_PAGE")) == "HTML_PAGE"


def status_class(status: Column) -> Column:
    return F.when(status.isNull(), "error").when(status < 300, "2xx").when(status < 400, "3xx").when(status < 500, "4xx").otherwise("5xx")


def distribution(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("count"))


def status_distribution(pages: DataFrame) -> DataFrame:
    return distribution(pages, status_class(F.col("status_code")), "bucket")


def depth_distribution(pages: DataFrame) -> DataFrame:
    return distribution(pages.where(is_page()), F.col("depth"), "depth")


def reason_distribution(pages: DataFrame) -> DataFrame:
    return distribution(pages.where(is_page()), F.col("indexability_reason"), "reason")


def severity_distribution(findings: DataFrame) -> DataFrame:
    return distribution(findings, F.col("severity"), "severity")


def top_issues(findings: DataFrame, most: int = 25) -> DataFrame:
    return findings.groupBy("code").agg(F.min("title").alias("title"), F.min("severity").alias("severity"), F.count("*").alias("count")).orderBy(F.desc("count"), "code").limit(most)


def directory_stats(pages: DataFrame, most: int = 30) -> DataFrame:
    """By directory as stored: a null one and / stay apart, both shown as /."""
    rows = pages.where(is_page()).groupBy("directory").agg(F.count("*").alias("pages"), F.count_if("indexable").alias("indexable"))
    return rows.orderBy(F.desc("pages"), "directory").limit(most).select(F.coalesce("directory", F.lit("/")).alias("directory"), "pages", "indexable")


def directory_breakdown(pages: DataFrame, most: int = 40) -> DataFrame:
    rows = pages.groupBy("directory").agg(F.count("*").alias("pages"), F.count_if("indexable").alias("indexable"), F.avg("depth").alias("avg_depth"), F.avg("internal_inlinks").alias("avg_inlinks"))
    return rows.orderBy(F.desc("pages"), "directory").limit(most)


def link_totals(links: DataFrame) -> DataFrame:
    return links.agg(F.count_if(F.col("link_type") == "INTERNAL").alias("internal"), F.count_if(F.col("link_type") == "EXTERNAL").alias("external"), F.count_if(~F.col("follow")).alias("nofollow"))


def totals(pages: DataFrame) -> DataFrame:
    """Requested, HTML, indexable, errors (as pages and at all), redirects, averages over HTML pages: one pass."""
    page, status = is_page(), F.col("status_code")
    return pages.agg(
        F.count("*").alias("requested_urls"), F.count_if(page).alias("html_pages"), F.count_if(page & F.col("indexable")).alias("indexable"),
        F.count_if(page & (status >= 400)).alias("errors_html"), F.count_if(status >= 400).alias("errors_all"), F.count_if(status.between(300, 399)).alias("redirects"),
        F.round(F.avg(F.when(page, F.col("depth"))), 2).alias("avg_depth"), F.round(F.avg(F.when(page, F.col("response_time")))).alias("avg_response_time"), F.round(F.avg(F.when(page, F.col("word_count")))).alias("avg_word_count"),
    )


def resource_types(pages: DataFrame) -> DataFrame:
    return distribution(pages, F.coalesce("resource_type", F.lit("UNKNOWN")), "resource_type")


def resource_stats(pages: DataFrame) -> DataFrame:
    """Requested, pages, discovered assets, images and how many are broken, broken assets, mismatches."""
    status, image = F.col("status_code"), F.col("media_type") == "IMAGE"
    failed = status.isNull() | (status >= 400)
    asset = F.col("media_type").isin("IMAGE", "CSS", "JAVASCRIPT", "FONT", "PDF", "OTHER_ASSET")
    one = pages.agg(
        F.count("*").alias("requested"), F.count_if(is_page()).alias("html_pages"), F.count_if(image).alias("images"), F.count_if(image & failed).alias("broken_images"),
        F.count_if(asset & failed).alias("broken_assets"), F.count_if("mime_mismatch").alias("mime_mismatches"),
    )
    return one.withColumn("discovered", F.greatest(F.lit(0), F.col("requested") - F.col("html_pages"))).withColumn("broken_image_ratio", F.when(F.col("images") > 0, F.round(F.col("broken_images") / F.col("images"), 4)).otherwise(0.0))


def image_stats(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements by alt state on HTML pages, pages that lack some, and the share without alt."""
    own = images.join(pages.where(is_page()).select(F.col("id").alias("page_id")), "page_id", "left_semi")
    missing = ~F.col("has_alt")
    blank = F.trim(F.coalesce("alt", F.lit(""))) == ""
    one = own.agg(
        F.count("*").alias("elements"), F.count_if(missing).alias("missing_alt"), F.count_if(~missing & blank).alias("decorative_alt"), F.count_if(~missing & ~blank).alias("described_alt"),
        F.count_distinct(F.when(missing, F.col("page_id"))).alias("pages_with_missing_alt"),
    )
    return one.withColumn("missing_alt_ratio", F.when(F.col("elements") > 0, F.round(F.col("missing_alt") / F.col("elements"), 4)).otherwise(0.0))


def cluster_summary(pages: DataFrame, most: int | None = 25) -> DataFrame:
    rows = pages.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.count("*").alias("pages"), F.avg("depth").alias("avg_depth"), F.max_by("normalized_url", F.struct(F.coalesce("internal_page_rank", F.lit(0.0)), -F.col("id"))).alias("top_url"),
    )
    return rows.orderBy(F.desc("pages"), "cluster_id").limit(most) if most else rows


def cluster_inbound(links: DataFrame, pages: DataFrame) -> DataFrame:
    flows = inter_group_links(links, pages, "cluster_id")
    return flows.where("from_group <> to_group").groupBy(F.col("to_group").alias("cluster_id")).agg(F.sum("links").alias("inbound_links"))


def top_by(pages: DataFrame, metric: str, most: int = 10) -> DataFrame:
    """Pages with the highest metric (bottlenecks, hubs, authorities)."""
    return pages.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), "id").limit(most).select("id", "normalized_url", metric)


def geo_stats(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of signals over indexable HTML pages (geo_signals struct), and whether about and contact pages exist, of all pages or by some columns."""
    g = F.col("geo_signals")
    own = is_page() & F.col("indexable")
    has = lambda c: F.count_if(own & F.coalesce(c, F.lit(False)))
    url = F.lower("normalized_url")
    return pages.groupBy(*(by or [])).agg(
        has(F.lit(True)).alias("total_indexable"), has(g["has_structured_data"]).alias("with_structured_data"),
        has(F.exists(g["schema_types"], lambda t: t.rlike("(?i)organization|localbusiness"))).alias("with_organization"), has(g["has_breadcrumbs"]).alias("with_breadcrumbs"),
        has(g["has_author"]).alias("with_author"), has(g["has_published_date"] | g["has_modified_date"]).alias("with_dates"), has(g["heading_structure_ok"]).alias("with_good_headings"),
        has(g["has_server_rendered_content"]).alias("with_server_content"), has(g["has_faq"]).alias("with_faq"), has(g["external_citations"] > 0).alias("with_citations"),
        F.coalesce(F.bool_or(url.rlike(ABOUT)), F.lit(False)).alias("has_about_page"), F.coalesce(F.bool_or(url.rlike(CONTACT)), F.lit(False)).alias("has_contact_page"),
    )


def geo_readiness(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Eight categories and their sum (at most 100); shares are rounded to whole per cents first."""
    n = F.col("total_indexable")
    part = lambda c, most: half_up(percent(F.col(c), n) / 100 * most).cast("long")
    some = lambda c, points: F.when(F.col(c) > 0, points).otherwise(0).cast("long")
    flag = lambda c: F.when(F.col(c), 5).otherwise(0).cast("long")
    cols = {
        "entity_clarity": some("with_organization", 15), "structured_data": part("with_structured_data", 20), "content_structure": part("with_good_headings", 15),
        "machine_readability": part("with_server_content", 15), "author_transparency": part("with_author", 10), "source_transparency": flag("has_about_page") + flag("has_contact_page"),
        "answerability": F.least(F.lit(10).cast("long"), part("with_dates", 5) + some("with_faq", 5)), "internal_semantic_linking": some("with_breadcrumbs", 5),
    }
    scored = stats.select(*(by or []), *(c.alias(k) for k, c in cols.items()))
    total = F.lit(0).cast("long")
    for k in cols:
        total = total + F.col(k)
    return scored.withColumn("score", total)


def seo_health(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """100 less the weighted number of findings for each HTML page, within 0 and 100."""
    weights = F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHTS.items() for x in kv])
    lost = findings.groupBy("severity").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.element_at(weights, F.col("severity")) * F.col("n")), F.lit(0.0)).alias("lost"))
    n = pages.agg(F.count_if(is_page()).alias("html_pages"))
    both = n.join(F.broadcast(lost))  # one row
    penalty = F.when(F.col("html_pages") > 0, F.col("lost") / F.col("html_pages")).otherwise(0.0)
    return both.select("html_pages", "lost", F.greatest(F.lit(0), F.least(F.lit(100), half_up(100 - penalty))).cast("long").alias("seo_health"))


#: What pages are counted by, in the order of the grouping's bits.
SETS = ["status", "depth", "reason", "directory", "resource_type", "cluster"]


def page_sets(pages: DataFrame) -> DataFrame:
    """Counts of pages by status, depth, reason, directory, resource type and community, and all totals: one scan, one shuffle.

    section names the set ('totals' for none) and key its value; n counts all pages, html the HTML pages. The other columns are
    the totals' figures. Grouping sets are summed where the pages are read, so that each task sends a row for each key it has met.
    """
    page, status, image = is_page(), F.col("status_code"), F.col("media_type") == "IMAGE"
    failed = status.isNull() | (status >= 400)
    asset = F.col("media_type").isin("IMAGE", "CSS", "JAVASCRIPT", "FONT", "PDF", "OTHER_ASSET")
    keyed = pages.select(
        page.alias("page"), status_class(status).alias("status"), F.col("depth").cast("string").alias("depth"), F.col("indexability_reason").alias("reason"), "directory", F.coalesce("resource_type", F.lit("UNKNOWN")).alias("resource_type"),
        F.col("cluster_id").cast("string").alias("cluster"), F.col("indexable").alias("x_indexable"), failed.alias("failed"), status.alias("code"), image.alias("image"), asset.alias("asset"), "mime_mismatch",
        *(F.when(page, F.col(c)).alias(f"x_{c}") for c in ("depth", "response_time", "word_count")),
    )
    c = F.col
    summed = keyed.groupingSets([*([k] for k in SETS), []], *SETS).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), F.count_if("page").alias("html"), F.count_if(c("page") & c("x_indexable")).alias("indexable"), F.count_if(c("page") & (c("code") >= 400)).alias("errors_html"),
        F.count_if(c("code") >= 400).alias("errors_all"), F.count_if(c("code").between(300, 399)).alias("redirects"), F.round(F.avg("x_depth"), 2).alias("avg_depth"), F.round(F.avg("x_response_time")).alias("avg_response_time"),
        F.round(F.avg("x_word_count")).alias("avg_word_count"), F.count_if("image").alias("images"), F.count_if(c("image") & c("failed")).alias("broken_images"), F.count_if(c("asset") & c("failed")).alias("broken_assets"), F.count_if("mime_mismatch").alias("mime_mismatches"),
    )
    every = (1 << len(SETS)) - 1
    section, key = F.lit("totals"), F.lit(None).cast("string")
    for k, name in enumerate(SETS):
        own = c("gid") == every - (1 << (len(SETS) - 1 - k))
        section, key = F.when(own, name).otherwise(section), F.when(own, c(name)).otherwise(key)
    return summed.select(section.alias("section"), key.alias("key"), *(x for x in summed.columns if x not in (*SETS, "gid")))


TOTALS = ["indexable", "errors_html", "errors_all", "redirects", "avg_depth", "avg_response_time", "avg_word_count", "images", "broken_images", "broken_assets", "mime_mismatches"]


def crawl_stats(pages: DataFrame, links: DataFrame, findings: DataFrame, *, directories: int = 30, codes: int = 25) -> DataFrame:
    """section, key, value: every figure of a crawl's statistics, from one scan each of its pages, links and findings."""
    sets = cut(page_sets(pages), "page-sets")
    issues = findings.groupingSets([["severity"], ["code"]], "severity", "code").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    issues = cut(issues.select(F.when(F.col("gid") == 1, "severity").otherwise("issue").alias("section"), F.coalesce("severity", "code").alias("key"), "n"), "issue-sets")
    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    of = lambda name: sets.where(F.col("section") == name)
    total = of("totals")
    named = {"requested_urls": F.col("n"), "html_pages": F.col("html"), "discovered": F.greatest(F.lit(0), F.col("n") - F.col("html")), **{k: F.col(k) for k in TOTALS}}
    named["broken_image_ratio"] = F.when(F.col("images") > 0, F.round(F.col("broken_images") / F.col("images"), 4)).otherwise(0.0)
    wide = total.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in named.items()))).alias("x"))
    parts = [wide.select(F.lit("totals").alias("section"), "x.key", "x.value"), row(of("status"), "status", F.col("key"), F.col("n")), row(of("resource_type"), "resource_type", F.col("key"), F.col("n"))]
    parts += [row(of(k).where("html > 0"), k, F.col("key"), F.col("html")) for k in ("depth", "reason")]
    parts.append(row(of("directory").where("html > 0").orderBy(F.desc("html"), "key").limit(directories), "directory", F.coalesce("key", F.lit("/")), F.col("html")))
    parts.append(row(of("cluster").where("key is not null"), "cluster", F.col("key"), F.col("n")))
    parts.append(row(issues.where("section = 'severity'"), "severity", F.col("key"), F.col("n")))
    parts.append(row(issues.where("section = 'issue'").orderBy(F.desc("n"), "key").limit(codes), "issue", F.col("key"), F.col("n")))
    sent = link_totals(links)
    parts += [row(sent, "links", F.lit(k), F.col(k)) for k in sent.columns]
    weights = F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHTS.items() for x in kv])
    lost = issues.where("section = 'severity'").agg(F.coalesce(F.sum(F.element_at(weights, F.col("key")) * F.col("n")), F.lit(0.0)).alias("lost"))
    penalty = F.when(F.col("html") > 0, F.col("lost") / F.col("html")).otherwise(0.0)
    parts.append(row(total.join(F.broadcast(lost)), "totals", F.lit("seo_health"), F.greatest(F.lit(0), F.least(F.lit(100), half_up(100 - penalty)))))  # one row each
    return reduce(DataFrame.unionByName, parts)


def requested_urls(stats: DataFrame) -> DataFrame:
    """stats (totals struct, resources and images structs, null in old crawls) with requested_urls and is_legacy."""
    return stats.withColumn("requested_urls", F.coalesce("totals.requested_urls", "totals.pages")).withColumn("is_legacy", F.col("resources").isNull() | F.col("images").isNull())


def progress(crawls: DataFrame, as_of: Column) -> DataFrame:
    """Elapsed seconds, URLs per minute, pending URLs of running crawls."""
    end = F.coalesce("finished_at", as_of)
    elapsed = F.greatest(F.lit(0), end.cast("long") - F.col("started_at").cast("long"))
    return crawls.withColumn("elapsed", elapsed).withColumn("urls_per_minute", F.when(F.col("elapsed") > 0, half_up(F.col("crawled") / F.col("elapsed") * 60)).otherwise(0)).withColumn("pending", F.greatest(F.lit(0), F.col("discovered") - F.col("crawled")))
