"""Keyword positions: best row for a query, daily history, previous and best positions, summaries, spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.lineage import cut
from ..functions.text import is_valid_keyword, normalize_country, normalize_device, normalize_keyword

LAG_DAYS = 3
COST_PER_CHECK = 0.005


def best_per_query(rows: DataFrame, *, key: str = "query", order: str = "input_order", min_impressions: float = 0) -> DataFrame:
    """The row with the best position of each normalised query; the first row wins ties, one without position only where none has one."""
    kept = rows.where(F.col("impressions") >= min_impressions) if min_impressions else rows
    normal = kept.withColumn("normalized", normalize_keyword(F.col(key)))
    whole = F.struct(*(F.col(c) for c in normal.columns))
    return normal.groupBy("normalized").agg(F.min_by(whole, F.struct(F.col("position").isNull(), "position", order)).alias("x")).select("x.*")


def match_tracked(keywords: DataFrame, best: DataFrame, day: Column) -> DataFrame:
    """A history row for each tracked keyword of a day; keywords without a row in best get one without position."""
    found = best.select("normalized", "position", "clicks", "impressions", "ctr", "url")
    return keywords.where("tracked").select("keyword_id", "normalized").join(found, "normalized", "left").select(
        "keyword_id", day.alias("date"), "position", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("impressions", F.lit(0)).alias("impressions"), F.coalesce("ctr", F.lit(0.0)).alias("ctr"), "url",
    )


def with_previous_and_best(history: DataFrame, *, key: str = "keyword_id", skip_null: bool = True) -> DataFrame:
    """history with previous_position, best_position and delta (positive: better).

    With skip_null days without a position leave no trace (search analytics); else the day before counts, null or not (result
    pages).
    """
    w = W.Window.partitionBy(key).orderBy("date")
    before = w.rowsBetween(W.Window.unboundedPreceding, -1)
    previous = F.last("position", ignorenulls=True).over(before) if skip_null else F.lag("position").over(w)
    best = F.min("position").over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    return history.withColumn("previous_position", previous).withColumn("best_position", best).withColumn("delta", F.col("previous_position") - F.col("position"))


def latest(history: DataFrame, *, key: str = "keyword_id") -> DataFrame:
    """The last row of each keyword, by aggregation."""
    whole = F.struct(*(F.col(c) for c in history.columns))
    return history.groupBy(key).agg(F.max_by(whole, F.col("date")).alias("__x")).select("__x.*")


def position_bucket(position: Column) -> Column:
    return F.when(position.isNull(), "none").when(position <= 3, "top3").when(position <= 10, "top10").when(position <= 30, "top30").otherwise("rest")


def keyword_summary(keywords: DataFrame) -> DataFrame:
    """One row: numbers by bucket, average position, clicks, impressions, better and worse keywords."""
    last, before = F.col("last_position"), F.col("previous_position")
    bucket = position_bucket(last)
    ranked = last.isNotNull()
    return keywords.agg(
        F.count("*").alias("total"), F.count_if("tracked").alias("tracked"), F.count_if(F.col("serp_position").isNotNull()).alias("serp_tracked"),
        *(F.count_if(bucket == b).alias(b) for b in ("top3", "top10", "top30", "rest", "none")),
        F.round(F.avg(last), 2).alias("average_position"), F.coalesce(F.sum(F.when(ranked, F.col("last_clicks"))), F.lit(0)).alias("total_clicks"), F.coalesce(F.sum(F.when(ranked, F.col("last_impressions"))), F.lit(0)).alias("total_impressions"),
        F.count_if(last < before).alias("improved"), F.count_if(last > before).alias("worsened"),
    )


def keyword_list(keywords: DataFrame, *, search: str | None = None, tracked: bool | None = None, source: str | None = None, tag: str | None = None, bucket: str | None = None, sort: str = "last_impressions", descending: bool = True) -> DataFrame:
    """Filtered keywords, sorted with nulls last. The top10 filter holds the top3 too, unlike the summary's bucket."""
    last = F.col("last_position")
    ranges = {"top3": last <= 3, "top10": last <= 10, "top30": last <= 30, "rest": last > 30, "none": last.isNull()}
    out = keywords
    for ok, condition in ((search, F.lower("keyword").contains((search or "").lower())), (tracked is not None, F.col("tracked") == bool(tracked)), (source, F.col("source") == source), (tag, F.col("tags").contains(tag or "")), (bucket in ranges, ranges.get(bucket or "", F.lit(True)))):
        out = out.where(condition) if ok else out
    return out.orderBy(F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort), "keyword_id")


def spend(checks: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Number and cost of checks of the last days."""
    return checks.where(F.col("date") >= F.date_sub(as_of, days)).agg(F.count("*").alias("checks"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 3).alias("cost_usd"))


def estimate_cost(keywords: int) -> dict[str, float]:
    return {"run": round(keywords * COST_PER_CHECK, 3), "month": round(keywords * COST_PER_CHECK * 30, 3)}


def since(history: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """History of the last days, 7 to 365."""
    return history.where(F.col("date") >= F.date_sub(as_of, min(max(days, 7), 365)))


def measured_day(as_of: Column, lag_days: int = LAG_DAYS) -> Column:
    return F.date_sub(as_of, lag_days)


def discover(rows: DataFrame, known: DataFrame, *, min_impressions: float = 1, limit: int = 5000) -> DataFrame:
    """Best rows of queries with enough impressions, most impressions first; is_new says which aren't known (normalized)."""
    best = best_per_query(rows, min_impressions=min_impressions).orderBy(F.desc("impressions"), "normalized").limit(limit)
    flagged = best.join(known.select("normalized", F.lit(False).alias("is_new")), "normalized", "left")
    return flagged.withColumn("is_new", F.coalesce("is_new", F.lit(True)))


def import_counters(incoming: DataFrame, existing: DataFrame, keys: list[str], *, read: int | None = None) -> DataFrame:
    """created, updated, skipped, total of an import by keys.

    A key's first row creates it if existing lacks it; every other row updates. skipped: of the read lines those that are no row of
    incoming. total is the number of keys.
    """
    known = existing.select(*keys).distinct().withColumn("__known", F.lit(True))
    one = incoming.groupBy(*keys).agg(F.count("*").alias("__n")).join(known, keys, "left")
    rows = F.coalesce(F.sum("__n"), F.lit(0)).cast("long")
    created = F.count_if(F.col("__known").isNull())
    return one.agg(created.alias("created"), (rows - created).alias("updated"), (F.lit(read) - rows if read is not None else F.lit(0)).cast("long").alias("skipped"), F.count("*").alias("total"))


KEYWORD_KEY = ["project_id", "normalized", "country", "device"]


def insert_manual(wanted: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New keyword rows, and one row of created and skipped, for wanted (project_id, keyword, country, device).

    Texts that are no keyword, keywords that are there already and repeats are skipped.
    """
    clean = wanted.withColumns({"normalized": normalize_keyword(F.col("keyword")), "country": F.coalesce(normalize_country(F.col("country")), F.lit("")), "device": F.coalesce(normalize_device(F.col("device")), F.lit(""))})
    valid = clean.where(is_valid_keyword(F.col("normalized"))).groupBy(*KEYWORD_KEY).agg(F.min(F.substring(F.trim("keyword"), 1, 255)).alias("keyword"))
    fresh = valid.join(existing.select(*KEYWORD_KEY).fillna("", ["country", "device"]), KEYWORD_KEY, "left_anti").withColumn("source", F.lit("MANUAL"))
    counts = wanted.agg(F.count("*").alias("n")).join(F.broadcast(fresh.agg(F.count("*").alias("created"))))  # one row each
    return fresh, counts.select("created", (F.col("n") - F.col("created")).alias("skipped"))


def track_day(keywords: DataFrame, analytics: DataFrame, history: DataFrame, day: Column, *, lag_days: int = LAG_DAYS) -> dict[str, DataFrame]:
    """A day's measurement: the new history, the keywords as they stand after it, and matched and processed.

    keywords: keyword_id, normalized, tracked and last_, previous_, best_position and last_ values; analytics: query, page, clicks,
    impressions, ctr, position, input_order; history: keyword_id, date, position, clicks, impressions, ctr, url. The day measured
    is lag_days before day. Rows of that day are replaced where the keyword was found, and kept or added empty where not.
    """
    best = best_per_query(analytics).withColumns({"clicks": F.round("clicks").cast("long"), "impressions": F.round("impressions").cast("long")}).withColumnRenamed("page", "url")
    measured = match_tracked(keywords, best, measured_day(day, lag_days))
    hit = measured.join(keywords.select("keyword_id", "normalized").join(best.select("normalized"), "normalized", "left_semi").select("keyword_id"), "keyword_id", "left_semi")
    missed = measured.join(hit.select("keyword_id"), "keyword_id", "left_anti").join(history.select("keyword_id", "date"), ["keyword_id", "date"], "left_anti")
    kept = history.join(hit.select("keyword_id", "date"), ["keyword_id", "date"], "left_anti")
    news = hit.select("keyword_id", *(F.col(c).alias(f"new_{c}") for c in ("position", "clicks", "impressions", "ctr", "url")), F.lit(True).alias("hit"))
    after = keywords.join(news, "keyword_id", "left")
    pick = lambda new, old: F.when(F.col("hit"), new).otherwise(F.col(old)).alias(old)
    changed = {
        "previous_position": pick(F.col("last_position"), "previous_position"), "last_position": pick(F.col("new_position"), "last_position"), "best_position": pick(F.least("best_position", "new_position"), "best_position"),
        "last_clicks": pick(F.col("new_clicks"), "last_clicks"), "last_impressions": pick(F.col("new_impressions"), "last_impressions"), "last_url": pick(F.col("new_url"), "last_url"),
    }
    counts = measured.agg(F.count("*").alias("processed")).join(F.broadcast(hit.agg(F.count("*").alias("matched"))))  # one row each
    return {"history": kept.unionByName(hit).unionByName(missed), "keywords": after.select(*(changed.get(c, F.col(c)) for c in keywords.columns)), "counters": counts}


def check_batch(keywords: DataFrame, answers: DataFrame, day: Column, *, balance: float | None = None, most_errors: int = 5) -> dict[str, DataFrame]:
    """Result-page checks of a batch of keywords: rows of the day, keywords after it, and the batch's counters.

    keywords: keyword_id, project_id and serp_position, serp_previous_position, serp_best_position, serp_url; answers: keyword_id,
    found, rank, rank_url, cost_usd, error (null if answered), as serp_checks() gives them. Keywords are asked in the order of
    their ids until the balance of their project is used up; what comes after is not asked. Errors cost nothing.
    """
    asked = keywords.select("keyword_id", "project_id").join(answers, "keyword_id").withColumn("cost_usd", F.when(F.col("error").isNull(), F.coalesce("cost_usd", F.lit(0.0))).otherwise(0.0))
    within = affordable(asked, balance) if balance is not None else asked
    ok = within.where(F.col("error").isNull())
    rows = ok.select("keyword_id", day.alias("date"), "found", "rank", "rank_url", "cost_usd")
    after = keywords.join(ok.select("keyword_id", "rank", "rank_url", F.lit(True).alias("asked")), "keyword_id", "left")
    pick = lambda new, old: F.when(F.col("asked"), new).otherwise(F.col(old)).alias(old)
    changed = {
        "serp_previous_position": pick(F.col("serp_position"), "serp_previous_position"), "serp_position": pick(F.col("rank"), "serp_position"),
        "serp_best_position": pick(F.least("serp_best_position", "rank"), "serp_best_position"), "serp_url": pick(F.col("rank_url"), "serp_url"),
    }
    counts = within.agg(
        F.count_if(F.col("error").isNull()).alias("checked"), F.count_if(F.col("error").isNull() & F.coalesce("found", F.lit(False))).alias("found"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"), F.count("*").alias("__n"),
    )
    counts = counts.join(F.broadcast(asked.agg(F.count("*").alias("__all")))).withColumn("out_of_balance", F.col("__n") < F.col("__all")).drop("__n", "__all")  # one row each
    errors = within.where(F.col("error").isNotNull()).orderBy("keyword_id").limit(most_errors).select("keyword_id", "error")
    return {"checks": rows, "keywords": after.select(*(changed.get(c, F.col(c)) for c in keywords.columns)), "counters": counts, "errors": errors}


def locations(known: DataFrame, most: int | None = 300) -> DataFrame:
    """Countries (names without a comma) first, then by name; total says how many there are in all."""
    total = known.agg(F.count("*").alias("total"))
    rows = known.join(F.broadcast(total)).orderBy(F.col("name").contains(","), "name")  # one row
    return rows.limit(most) if most else rows


def affordable(checks: DataFrame, balance: float, *, order: str = "keyword_id") -> DataFrame:
    """Checks in order as long as the running cost (spent, to nine digits) of their project stays within a balance.

    The checks are written in ranges of project and order; a range's costs before it are summed up from the ranges, and those
    inside it within it. So no task holds a project, and however many ranges there are, a project's sums are the same.
    """
    made = ["spent", "__range"]
    ranges = cut(checks.drop(*made).repartitionByRange("project_id", order).withColumn("__range", F.spark_partition_id()), "ranges")
    by = ["project_id", "__range"]
    before = W.Window.partitionBy("project_id").orderBy("__range").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = ranges.groupBy(*by).agg(F.sum("cost_usd").alias("cost")).select(*by, F.coalesce(F.sum("cost").over(before), F.lit(0.0)).alias("__before"))
    inside = F.sum("cost_usd").over(W.Window.partitionBy(*by).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0))
    spent = ranges.withColumn("__inside", inside).join(sums, by).withColumn("spent", F.round(F.col("__before") + F.col("__inside"), 9))
    return spent.where(F.col("spent") <= balance).drop("__inside", "__before", "__range")


def due_projects(projects: DataFrame, jobs: DataFrame, day: Column) -> DataFrame:
    """Projects with tracked keywords and no job of the day yet."""
    return projects.where("has_tracked").join(jobs.where(F.col("date") == day), "project_id", "left_anti")


def stale_jobs(jobs: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """Running jobs without heartbeat for some minutes."""
    return jobs.where((F.col("status") == "RUNNING") & (F.col("heartbeat_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))
