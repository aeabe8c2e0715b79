"""Keyword imports: rows of a file, or queries that a site ranks for, put into the keyword table and its daily history.

The keyword table has one row for each project, normalised keyword, country and device (KEYWORD_KEY); the history has one for each
of these and a day. An import is the outcome of its rows taken one after another in their order: each row after a keyword's first
changes the keyword that is there by then. Here the outcome follows from aggregates over a keyword's rows (the last value of each
column, the last position but one), so that tasks sum up before the shuffle and no keyword's rows come together in one task. They
are summed up by the text of the keyword as it came first; only texts are normalised, and then summed up by KEYWORD_KEY.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.seo import half_up
from ..functions.text import is_valid_keyword, normalize_country, normalize_device, normalize_keyword
from .keywords import KEYWORD_KEY, best_per_query

KEYWORDS = (
    "project_id string, normalized string, country string, device string, keyword string, source string, tracked boolean, tags string, target_url string, last_position double, previous_position double, "
    "best_position double, last_clicks long, last_impressions long, last_ctr double, last_url string, last_checked_at date"
)
HISTORY = "project_id string, normalized string, country string, device string, date date, position double, clicks long, impressions long, ctr double, url string, source string"
#: KEYWORD_KEY as joins take it: what differs most first, as rows are sorted by it.
JOIN_KEY = sorted(KEYWORD_KEY, key=lambda c: c != "normalized")
#: What a row says of its keyword, before it is normalised.
TEXT = ["project_id", "keyword", "country", "device"]
DAY_KEY = [*KEYWORD_KEY, "date"]
#: Columns of the keyword table that an import changes.
CHANGED = ["keyword", "tags", "target_url", "last_position", "previous_position", "best_position", "last_clicks", "last_impressions", "last_ctr", "last_url", "last_checked_at"]


def _counters(source: str, total: Column, created: Column, skipped: Column) -> list[Column]:
    return [F.lit(source).alias("source"), total.alias("total"), created.alias("created"), (total - created - skipped).alias("updated"), skipped.alias("skipped")]


def _merged(keywords: DataFrame, changes: DataFrame, source: str, tracked: bool) -> DataFrame:
    """keywords with changes (KEYWORD_KEY, CHANGED as new_..., moved: whether a position came in) and the new ones among them."""
    both = keywords.withColumn("__old", F.lit(True)).join(changes, JOIN_KEY, "full_outer")
    old, new = F.col("__old").isNotNull(), lambda c: F.col(f"new_{c}")
    kept = {c: F.coalesce(new(c), F.col(c)) for c in CHANGED}
    kept["best_position"] = F.least("best_position", "new_best_position")
    kept["previous_position"] = F.when(F.col("again"), F.col("new_previous_position")).when(F.col("moved"), F.col("last_position")).otherwise(F.col("previous_position"))
    made = {"source": F.when(old, F.col("source")).otherwise(source), "tracked": F.when(old, F.col("tracked")).otherwise(tracked)}
    return both.select(*((kept | made).get(c, F.col(c)).alias(c) for c in keywords.columns))


def _named(texts: DataFrame) -> DataFrame:
    """What rows of a text (TEXT as it came) add up to, with the text cut, its KEYWORD_KEY and whether it is valid."""
    cut = F.substring(F.trim("keyword"), 1, 255)
    rest = [c for c in texts.columns if c not in ("h", *TEXT)]
    flagged = texts.withColumn("valid", is_valid_keyword(normalize_keyword(F.col("keyword"))))
    return flagged.select("project_id", normalize_keyword(cut).alias("normalized"), normalize_country(F.col("country")).alias("country"), normalize_device(F.col("device")).alias("device"), cut.alias("keyword"), "valid", *rest)


def import_rows(rows: DataFrame, keywords: DataFrame, history: DataFrame, today: Column, *, order: str = "n", source: str = "CSV") -> dict[str, DataFrame]:
    """The keyword table and the history after an import of rows, and one row of its counters.

    rows: project_id, keyword, position, clicks, impressions, ctr, url, country, device, date, tags, and a place in order that no
    two rows share (any type that sorts). Countries and devices are normalised here. A row whose keyword is empty or too long is
    skipped; a row without date is of today. What a row lacks changes nothing; a position moves the last one to the previous one.
    Rows with a position, clicks or impressions replace their day in the history, the last of a day counts. Every row that is
    neither skipped nor a new keyword's first counts as updated.
    """
    rows = rows.select(
        F.xxhash64(*TEXT).alias("h"), *TEXT, F.col(order).alias("n"), F.col("position").cast("double").alias("position"), half_up(F.col("clicks")).cast("long").alias("clicks"), half_up(F.col("impressions")).cast("long").alias("impressions"),
        F.col("ctr").cast("double").alias("ctr"), F.nullif(F.trim("url"), F.lit("")).alias("url"), F.nullif(F.trim("tags"), F.lit("")).alias("tags"), F.coalesce("date", today).cast("date").alias("date"),
    )
    text = ["h", *TEXT]  # the hash first: rows are sorted by it and seldom by the strings
    last = lambda c, of=None: F.max(F.when(F.col(of or c).isNotNull(), F.struct("n", c))).alias(c)
    texts = rows.groupBy(*text).agg(
        F.count("*").alias("rows"), F.max("n").alias("n"), F.min("position").alias("best"), last("date", "position"),
        *(last(c) for c in ("tags", "url", "position", "clicks", "impressions", "ctr")),
    )
    whole = _named(texts)
    one = whole.where("valid").groupBy(*KEYWORD_KEY).agg(
        F.max_by("keyword", "n").alias("new_keyword"), *(F.max(c).alias(c) for c in ("tags", "url", "position", "date", "clicks", "impressions", "ctr")), F.min("best").alias("new_best_position"),
    ).select(
        *KEYWORD_KEY, "new_keyword", F.col("tags.tags").alias("new_tags"), F.col("url.url").alias("new_target_url"), F.col("url.url").alias("new_last_url"), F.col("position.position").alias("new_last_position"), "new_best_position",
        F.col("clicks.clicks").alias("new_last_clicks"), F.col("impressions.impressions").alias("new_last_impressions"), F.col("ctr.ctr").alias("new_last_ctr"), F.col("date.date").alias("new_last_checked_at"), F.col("position").isNotNull().alias("moved"),
    )
    newest = lambda key: F.row_number().over(W.Window.partitionBy(*key).orderBy(F.desc("n")))
    measured = rows.where("position is not null").select(*text, "n", "position").withColumn("place", newest(text)).where("place <= 2")  # tasks keep two rows of a text before the shuffle
    before = _named(measured).where("valid").withColumn("place", newest(KEYWORD_KEY)).where("place = 2").select(*KEYWORD_KEY, F.col("position").alias("new_previous_position"), F.lit(True).alias("again"))
    changes = one.join(before, JOIN_KEY, "left")
    day = F.struct("n", "position", F.coalesce("clicks", F.lit(0).cast("long")).alias("clicks"), F.coalesce("impressions", F.lit(0).cast("long")).alias("impressions"), F.coalesce("ctr", F.lit(0.0)).alias("ctr"), "url", F.lit(source).alias("source"))
    figures = rows.where("position is not null or clicks is not null or impressions is not null").groupBy(*text, "date").agg(F.max(day).alias("d"))
    days = _named(figures).where("valid").groupBy(*DAY_KEY).agg(F.max("d").alias("d")).select(*DAY_KEY, "d.*").drop("n")
    fresh = one.select(*KEYWORD_KEY).join(keywords.select(*KEYWORD_KEY), JOIN_KEY, "left_anti").agg(F.count("*").alias("created"))
    number = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    counted = whole.agg(number(F.col("rows")).alias("total"), number(F.when(~F.col("valid"), F.col("rows"))).alias("skipped")).join(F.broadcast(fresh))  # one row each
    return {
        "keywords": _merged(keywords, changes, source, True),
        "history": history.join(days.select(*DAY_KEY), DAY_KEY, "left_anti").unionByName(days.select(*history.columns)),
        "counters": counted.select(*_counters(source, F.col("total"), F.col("created"), F.col("skipped"))),
    }


def register_queries(rows: DataFrame, keywords: DataFrame, project_id: str, today: Column, *, min_impressions: float = 1, limit: int = 5000, track: bool = True) -> dict[str, DataFrame]:
    """The keyword table after the queries that a site ranks for are put into it, and one row of counters.

    rows: query, page, clicks, impressions, ctr, position, input_order of a period. Of each query the row with the best position
    counts, of these the limit with most impressions; ties go by the query. Rows that aren't taken count as skipped.
    """
    taken = best_per_query(rows, min_impressions=min_impressions).orderBy(F.desc("impressions"), "normalized").limit(limit)
    changes = taken.select(
        F.lit(project_id).alias("project_id"), "normalized", normalize_country(F.lit(None).cast("string")).alias("country"), normalize_device(F.lit(None).cast("string")).alias("device"), F.substring("query", 1, 255).alias("new_keyword"), F.lit(None).cast("string").alias("new_tags"),
        F.col("page").alias("new_target_url"), F.col("page").alias("new_last_url"), F.col("position").alias("new_last_position"), F.col("position").alias("new_best_position"), half_up(F.col("clicks")).cast("long").alias("new_last_clicks"),
        half_up(F.col("impressions")).cast("long").alias("new_last_impressions"), F.col("ctr").alias("new_last_ctr"), today.cast("date").alias("new_last_checked_at"), F.lit(None).cast("double").alias("new_previous_position"), F.lit(False).alias("again"), F.lit(True).alias("moved"),
    )
    known = keywords.select(*KEYWORD_KEY, F.col("keyword").alias("__keyword"), F.col("target_url").alias("__target"))
    changes = changes.join(known, KEYWORD_KEY, "left")  # the text and the target of a keyword that is there stay
    stay = lambda there, new: F.when(F.col("__keyword").isNotNull(), F.col(there)).otherwise(F.col(new))
    changes = changes.withColumns({"new_keyword": stay("__keyword", "new_keyword"), "new_target_url": stay("__target", "new_target_url")}).withColumn("fresh", F.col("__keyword").isNull()).drop("__keyword", "__target")
    counts = changes.agg(F.count("*").alias("taken"), F.count_if("fresh").alias("created"))
    counted = rows.agg(F.count("*").alias("total")).join(F.broadcast(counts))  # one row each
    return {"keywords": _merged(keywords, changes.drop("fresh"), "GSC", track), "counters": counted.select(*_counters("GSC", F.col("total"), F.col("created"), F.col("total") - F.col("taken")))}
