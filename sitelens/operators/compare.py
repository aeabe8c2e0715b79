"""Two crawls of a project side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.lineage import cut
from ..functions.seo import SEVERITY_WEIGHTS, half_up
from . import stats

#: The metrics of a comparison, and whether more of them is better.
METRICS = {
    "crawled_urls": True, "indexable": True, "errors": False, "redirects": False, "internal_links": True, "average_depth": False, "seo_health": True, "geo_readiness": True, "issues": False,
}


def added(base: DataFrame, target: DataFrame) -> DataFrame:
    """Pages of target whose URL base doesn't have; removed() the other way round."""
    return target.join(base.select("url_hash"), "url_hash", "left_anti")


def removed(base: DataFrame, target: DataFrame) -> DataFrame:
    return added(target, base)


def _both(base: DataFrame, target: DataFrame, column: str) -> DataFrame:
    a = base.select("url_hash", F.col(column).alias("before"))
    return target.select("url_hash", "normalized_url", F.col(column).alias("after")).join(a, "url_hash")


def status_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """Other status than before; from or to no answer counts."""
    return _both(base, target, "status_code").where(~F.col("before").eqNullSafe(F.col("after")))


def indexability_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    return _both(base, target, "indexability_reason").where(F.col("before") != F.col("after"))


def issue_deltas(base_findings: DataFrame, target_findings: DataFrame) -> DataFrame:
    """Findings by code before and after, largest change first."""
    count = lambda df, name: df.groupBy("code").agg(F.count("*").alias(name))
    both = count(base_findings, "before").join(count(target_findings, "after"), "code", "full_outer").fillna(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before")).orderBy(F.desc(F.abs("delta")), "code")


def metric_deltas(base: DataFrame, target: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, before, after, delta from two one-row tables."""
    def long(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x"))
        return rows.select("x.*")

    return long(base, "before").join(long(target, "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))


def comparison_counts(base: DataFrame, target: DataFrame) -> DataFrame:
    """Number of added and removed pages, status and indexability changes."""
    parts = {"added": added(base, target), "removed": removed(base, target), "status_changed": status_changes(base, target), "indexability_changed": indexability_changes(base, target)}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("count")).select(F.lit(k).alias("change"), "count") for k, df in parts.items()])


def latest_two(crawls: DataFrame) -> DataFrame:
    """project_id, target_id and base_id: the latest completed crawl and the one before."""
    w = W.Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = crawls.where(F.col("status") == "COMPLETED").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= 2)
    return ranked.groupBy("project_id").agg(F.max(F.when(F.col("__n") == 1, F.col("id"))).alias("target_id"), F.max(F.when(F.col("__n") == 2, F.col("id"))).alias("base_id"))


def crawl_metrics(pages: DataFrame, links: DataFrame, findings: DataFrame) -> DataFrame:
    """crawl_id and METRICS of every crawl that pages are of, from one aggregation each of pages, links and findings.

    links and findings belong to the crawl of their page (source_page_id, page_id). Readiness is 0 where pages have no geo_signals.
    """
    by, page, status = ["crawl_id"], stats.is_page(), F.col("status_code")
    totals = pages.groupBy(*by).agg(
        F.count("*").alias("crawled_urls"), F.count_if(page).alias("__html"), F.count_if(page & F.col("indexable")).alias("indexable"), F.count_if(page & (status >= 400)).alias("errors"),
        F.count_if(status.between(300, 399)).alias("redirects"), F.coalesce(F.round(F.avg(F.when(page, F.col("depth"))), 2), F.lit(0.0)).alias("average_depth"),
    )
    of = lambda key: pages.select(F.col("id").alias(key), *by)
    sent = links.select("source_page_id", "link_type").join(of("source_page_id"), "source_page_id").groupBy(*by).agg(F.count_if(F.col("link_type") == "INTERNAL").alias("internal_links"))
    weights = F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHTS.items() for x in kv])
    found = findings.select("page_id", "severity").join(of("page_id"), "page_id").groupBy(*by, "severity").agg(F.count("*").alias("n"))
    lost = found.groupBy(*by).agg(F.sum("n").alias("issues"), F.sum(F.element_at(weights, F.col("severity")) * F.col("n")).alias("__lost"))
    parts = [sent, lost]
    if "geo_signals" in pages.columns:
        parts.append(stats.geo_readiness(stats.geo_stats(pages, by), by).select(*by, F.col("score").alias("geo_readiness")))
    one = reduce(lambda x, y: x.join(y, by, "left"), parts, totals)
    penalty = F.when(F.col("__html") > 0, F.coalesce("__lost", F.lit(0.0)) / F.col("__html")).otherwise(0.0)
    one = one.withColumn("seo_health", F.greatest(F.lit(0), F.least(F.lit(100), half_up(100 - penalty))).cast("long"))
    return one.select(*by, *(F.coalesce(F.col(m), F.lit(0)).alias(m) if m in one.columns else F.lit(0).alias(m) for m in METRICS))


def compare_crawls(base_id: object, target_id: object, crawls: DataFrame, pages: DataFrame, links: DataFrame, findings: DataFrame, *, most: int | None = None) -> dict[str, DataFrame]:
    """Everything that changed from one crawl of a project to another: counts, metrics, URLs, statuses, indexability, issues.

    crawls has id and project_id; pages crawl_id; links source_page_id and findings page_id of these pages. Crawls of two projects
    are an error. most limits the lists of URLs, as the product shows 100 of each.
    """
    known = {r["id"]: r["project_id"] for r in crawls.where(F.col("id").isin(base_id, target_id)).select("id", "project_id").collect()}  # two rows
    if set(known) != {base_id, target_id} or len(set(known.values())) != 1:
        raise ValueError("two crawls of one project are needed")
    a, b = (pages.where(F.col("crawl_id") == x) for x in (base_id, target_id))
    own = lambda df, key, side: df.join(side.select(F.col("id").alias(key)), key, "left_semi")
    found = [own(findings, "page_id", x) for x in (a, b)]
    both = pages.where(F.col("crawl_id").isin(base_id, target_id))
    asked = pages.sparkSession.createDataFrame([(base_id,), (target_id,)], T.StructType([T.StructField("crawl_id", pages.schema["crawl_id"].dataType)]))
    counted = cut(asked.distinct().join(F.broadcast(crawl_metrics(both, links, findings)), "crawl_id", "left").fillna({"seo_health": 100}).fillna(0), "crawl-metrics")  # a row for each of the two
    measured = [counted.where(F.col("crawl_id") == x) for x in (base_id, target_id)]
    better = F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv))
    first = lambda df: df.orderBy("normalized_url").limit(most) if most else df
    url = lambda df: first(df.select("id", "normalized_url", "status_code"))
    return {
        "metrics": metric_deltas(*measured, [*METRICS]).withColumn("higher_is_better", F.element_at(better, F.col("metric"))),
        "added": url(added(a, b)), "removed": url(removed(a, b)), "status_changes": first(status_changes(a, b)),
        "indexability_changes": first(indexability_changes(a, b)), "issue_deltas": issue_deltas(*found).where("delta <> 0"), "counts": comparison_counts(a, b),
    }
