"""Recorded answers of search interfaces as rows: paged search analytics, in batch and as a stream, and result pages.

Answers are JSON lines that Spark reads, wherever its file systems reach. A page is known by site, day and first row; which pages
are still to be asked for follows from those that are there, so that a job that broke off goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import effective_rank, top_organic

ANALYTICS = "rows array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>"
SERP = "keyword string, cost double, found boolean, rank_group int, rank_absolute int, url string, total_results long, items array<struct<type:string,rank_group:int,rank_absolute:int,domain:string,url:string,title:string>>"


def analytics_rows(answers: DataFrame, dimensions: list[str], body: str = "body") -> DataFrame:
    """A row for each element of the answers' rows; keys get the dimensions' names."""
    rows = answers.select(F.explode(F.from_json(body, ANALYTICS)["rows"]).alias("r"))
    return rows.select(*(F.get("r.keys", F.lit(i)).alias(d) for i, d in enumerate(dimensions)), "r.clicks", "r.impressions", "r.ctr", "r.position")


def serp_checks(answers: DataFrame, body: str = "body") -> DataFrame:
    """Rank, features and top results of each recorded result page."""
    x = answers.withColumn("__x", F.from_json(body, SERP))
    features = F.array_distinct(F.transform(F.filter("__x.items", lambda i: i["type"] != "organic"), lambda i: i["type"]))
    return x.select(
        *answers.columns, F.col("__x.found").alias("found"), effective_rank(F.col("__x.found"), F.col("__x.rank_group"), F.col("__x.rank_absolute")).alias("rank"), F.col("__x.url").alias("rank_url"),
        F.array_join(features, ",").alias("feature_types"), top_organic(F.col("__x.items")).alias("top_results"), F.col("__x.total_results").alias("total_results"), F.col("__x.cost").alias("cost_usd"),
    )


HISTORY = "data struct<snapshots:array<struct<captured_at:string,rank_absolute:int,rank_group:int,url:string>>>"
#: Snapshots that one answer holds at most, and what it holds if nothing is asked for.
MOST_SNAPSHOTS, SNAPSHOTS = 1000, 100


def history_requests(tracked: DataFrame, limit: int = SNAPSHOTS) -> DataFrame:
    """tracked (keyword, target and, each may be null, location_code, language_code, device) with the query string that asks for its recorded ranks."""
    names = [c for c in ("keyword", "target", "location_code", "language_code", "device") if c in tracked.columns]
    given = F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}="), F.url_encode(F.col(c).cast("string")))) for c in names))
    return tracked.withColumn("request", F.concat_ws("&", F.array_compact(given), F.lit(f"limit={min(limit, MOST_SNAPSHOTS)}")))


def rank_history(answers: DataFrame, body: str = "body") -> DataFrame:
    """answers (keyword, target, ...) with a row for each day of their snapshots: captured_at, rank, rank_url, the last of the day.

    A snapshot without a rank in its group has the rank on the whole page. Answers that are no JSON or hold no snapshots give no rows.
    """
    keep = [c for c in answers.columns if c != body]
    each = answers.select(*keep, F.explode(F.from_json(body, HISTORY)["data"]["snapshots"]).alias("__s"))
    at = F.to_timestamp("__s.captured_at")
    rows = each.select(*keep, at.cast("date").alias("date"), at.alias("captured_at"), F.coalesce("__s.rank_group", "__s.rank_absolute").alias("rank"), F.col("__s.url").alias("rank_url")).where(F.col("captured_at").isNotNull())
    last = F.max(F.struct("captured_at", (-F.col("rank")).alias("better"), "rank", "rank_url"))
    return rows.groupBy(*keep, "date").agg(last.alias("m")).select(*keep, "date", "m.captured_at", "m.rank", "m.rank_url")


def reference_rows(answers: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """code, name (and country_iso_code) of the latest recorded list of locations or languages; answers has fetched_at."""
    fields = {"locations": "code:int,name:string,country_iso_code:string", "languages": "code:string,name:string"}[kind]
    whole = answers.select("fetched_at", F.from_json(body, f"data struct<{kind}:array<struct<{fields}>>>")["data"][kind].alias("rows")).where("rows is not null")
    return whole.groupBy().agg(F.max_by("rows", "fetched_at").alias("rows")).select(F.inline("rows")).distinct()


#: Rows of a full page, as the interface gives them: a shorter one is a day's last.
PAGE_ROWS = 25_000
PAGE = "site string, date date, start_row long, fetched_at timestamp, body string"
PAGE_KEY = ["site", "date", "start_row"]
RESPONSE = "url string, status int, content_type string, body string, location string, error_type string"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Answers to fetches, recorded as JSON lines."""
    return spark.read.schema(RESPONSE).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded pages of search analytics."""
    return spark.read.schema(PAGE).json(path)


def stream_pages(spark: SparkSession, path: str, *, files: int | None = None) -> DataFrame:
    """Recorded pages as a stream of files; the checkpoint's log of files says where it goes on."""
    reader = spark.readStream.schema(PAGE)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def latest_pages(pages: DataFrame) -> DataFrame:
    """Each page once, as it was fetched last."""
    return pages.groupBy(*PAGE_KEY).agg(F.max(F.struct("fetched_at", "body")).alias("m")).select(*PAGE_KEY, "m.fetched_at", "m.body")


def _sized(pages: DataFrame) -> DataFrame:
    return latest_pages(pages).withColumn("n", F.coalesce(F.array_size(F.from_json("body", ANALYTICS)["rows"]), F.lit(0)))


def next_requests(asked: DataFrame, pages: DataFrame, *, page_rows: int = PAGE_ROWS) -> DataFrame:
    """site, date, start_row of the first page that each asked day (site, date) still lacks; days that are whole give none.

    A day lacks its first page, and the one behind each full page, if they aren't there.
    """
    days = asked.select("site", "date").distinct()
    full = _sized(pages).where(F.col("n") >= page_rows).select("site", "date", (F.col("start_row") + page_rows).alias("start_row"))
    wanted = days.withColumn("start_row", F.lit(0).cast("long")).unionByName(full.join(days, ["site", "date"], "left_semi"))
    return wanted.join(pages.select(*PAGE_KEY), PAGE_KEY, "left_anti").groupBy("site", "date").agg(F.min("start_row").alias("start_row"))


def day_counts(pages: DataFrame, *, page_rows: int = PAGE_ROWS) -> DataFrame:
    """site, date, pages, rows, whole of the days that there are pages of."""
    sized = _sized(pages)
    lacking = next_requests(sized, pages, page_rows=page_rows).select("site", "date", F.lit(False).alias("whole"))
    counts = sized.groupBy("site", "date").agg(F.count("*").alias("pages"), F.sum("n").alias("rows"))
    return counts.join(lacking, ["site", "date"], "left").withColumn("whole", F.coalesce("whole", F.lit(True)))


def page_rows_of(pages: DataFrame, dimensions: list[str]) -> DataFrame:
    """site, date, input_order (the row's place in its day), the dimensions and figures of the rows of all pages, each page once."""
    rows = latest_pages(pages).select("site", "date", "start_row", F.posexplode(F.from_json("body", ANALYTICS)["rows"]).alias("k", "r"))
    names = [F.get("r.keys", F.lit(i)).alias(d) for i, d in enumerate(dimensions)]
    return rows.select("site", "date", (F.col("start_row") + F.col("k")).alias("input_order"), *names, "r.clicks", "r.impressions", "r.ctr", "r.position")


def write_pages(stream: DataFrame, path: str, checkpoint: str, *, after: Callable[[int], None] | None = None):
    """Start writing a stream's pages; a micro-batch replaces its own folder, so that one which is repeated adds nothing twice.

    after is called with a batch's number when it is written. Read the folder with latest_pages(): a page fetched again is there twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        latest_pages(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after:
            after(number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
