"""Indexability, robots tokens, alt texts, hreflang codes, page signals, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .resources import is_html_page

SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
# What an issue of each severity takes off a site's health.
SEVERITY_WEIGHTS = {"CRITICAL": 12.0, "HIGH": 6.0, "MEDIUM": 2.5, "LOW": 0.8, "INFO": 0.0}


def has_noindex(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?i)(^|[,\s])(noindex|none)($|[,\s])"), F.lit(False))


def is_nofollow(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?i)(^|[,\s])(nofollow|none)($|[,\s])"), F.lit(False))


def indexability(status: Column, meta_robots: Column, x_robots: Column, canonical_normalized: Column, normalized_url: Column, blocked: Column, is_html: Column, has_error: Column) -> Column:
    """Reason; INDEXABLE if nothing stands against it. The hardest reason comes first."""
    return (
        F.when(blocked, "BLOCKED_ROBOTS")
        .when(has_error | status.isNull(), "FETCH_ERROR")
        .when(status >= 500, "SERVER_ERROR")
        .when(status >= 400, "CLIENT_ERROR")
        .when(status >= 300, "REDIRECT")
        .when(~is_html, "UNSUPPORTED_CONTENT")
        .when(has_noindex(meta_robots) | has_noindex(x_robots), "NOINDEX")
        .when((canonical_normalized != "") & (canonical_normalized != normalized_url), "CANONICALIZED")
        .otherwise("INDEXABLE")
    )


def is_auditable(resource_type: Column, content_type: Column, status: Column) -> Column:
    """An HTML page that answered 2xx."""
    return F.coalesce(is_html_page(resource_type, content_type) & status.between(200, 299), F.lit(False))


def alt_state(has_alt: Column, alt: Column) -> Column:
    return F.when(~has_alt, "MISSING").when(F.trim(F.coalesce(alt, F.lit(""))) == "", "DECORATIVE").otherwise("DESCRIPTIVE")


def clean(text: Column) -> Column:
    """White space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def int_attribute(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def is_valid_hreflang(code: Column) -> Column:
    """Language, then script and region as far as given; or x-default."""
    c = F.trim(code)
    return F.coalesce((F.lower(c) == "x-default") | c.rlike(r"^[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?$"), F.lit(False))


def geo_signals(schema_types: Column, has_author: Column, published: Column, modified: Column, h1_count: Column, h2_count: Column, words: Column, citations: Column, text_ratio: Column) -> Column:
    """Struct of what helps machines to read a page."""
    types = F.array_distinct(F.filter(schema_types, lambda t: t.isNotNull() & (t != "")))
    lower = F.transform(types, F.lower)
    return F.struct(
        (F.size(schema_types) > 0).alias("has_structured_data"), F.slice(types, 1, 20).alias("schema_types"), has_author.alias("has_author"),
        published.isNotNull().alias("has_published_date"), modified.isNotNull().alias("has_modified_date"),
        F.array_contains(lower, "breadcrumblist").alias("has_breadcrumbs"), F.array_contains(lower, "faqpage").alias("has_faq"),
        ((h1_count == 1) & ((words < 300) | (h2_count >= 1))).alias("heading_structure_ok"), (words >= 150).alias("has_server_rendered_content"),
        citations.alias("external_citations"), text_ratio.alias("text_ratio"),
    )


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(part / total * 100)).otherwise(0)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def crawl_failed(error_type: Column, status: Column) -> Column:
    """Whether a fetched URL counts as failed."""
    return F.coalesce(error_type.isNotNull() & (error_type != "UNSUPPORTED_CONTENT"), F.lit(False)) | F.coalesce(status >= 400, F.lit(False))
