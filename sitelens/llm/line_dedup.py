"""Line de-duplication by spread over distinct sites, with DataFrame functions only.

One aggregation merges a HyperLogLog sketch of the sites of each line hash. Lines whose estimate is clearly at or above the
threshold are boilerplate; those near it get an exact distinct count. Of a boilerplate line the occurrence in the smallest
doc_id (then the first in it) stays and every other goes, so that one copy of the passage is left in the corpus and a document
that others copied keeps its text.

Lines end at a line feed. Every non-empty line counts, however short. Null texts stay null, empty ones empty; texts without
removed lines stay as they are, byte for byte. A null site is one more site. Repeated rows (same doc_id and text) are treated
alike. Other columns pass through, whatever their names; those named as one of the counts give way to it if counts are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, unused

MIN_SITES = 3
#: log2 of the sketch's registers, and the relative margin (six standard errors) inside which counts are made exactly.
LG_REGISTERS = 12
MARGIN = 0.1


def _lines(docs: DataFrame, text: str, site: str, key: str) -> DataFrame:
    """A row for each non-empty line: document (id and text hash), place, 128-bit hash of the line, site."""
    split = F.split(F.col(text), "\n", -1)
    rows = docs.select(F.coalesce(F.col(key), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("th"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(split).alias("at", "line"))
    return rows.where(F.col("line") != "").select("id", "th", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of lines on min_sites distinct sites or more, and where each occurs first."""
    by = ["h1", "h2"]
    spread = lines.groupBy(*by).agg(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first"))
    spread = cut(spread.where(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch"), "line-spread")
    margin = max(1, int(MARGIN * min_sites) + 1)
    near = spread.where(F.col("sites").between(min_sites - margin, min_sites + margin)).select(*by, "first")
    exact = lines.join(near.select(*by), by, "left_semi").groupBy(*by).agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return near.join(exact.select(*by), by, "left_semi").unionByName(spread.where(F.col("sites") > min_sites + margin).select(*by, "first"))


def _flags(places: str) -> Column:
    """An array that is true at the given places (sorted) and false between them; it ends with the last."""
    before = F.concat(F.array(F.lit(-1)), F.slice(places, F.lit(1), F.size(places) - 1))
    return F.flatten(F.zip_with(places, before, lambda at, last: F.concat(F.array_repeat(F.lit(False), at - last - 1), F.array(F.lit(True)))))


def dedup_lines(docs: DataFrame, *, text: str = "text", site: str = "source", key: str = "doc_id", min_sites: int = MIN_SITES, counts: bool = False) -> DataFrame:
    """docs with boilerplate lines removed from text; with counts also __n_lines and __n_removed."""
    made = ["__n_lines", "__n_removed"] if counts else []
    keep = [c for c in docs.columns if c not in made]
    gone, many, own, th = unused(docs.columns, "gone", "many", "id", "th")
    lines = cut(_lines(docs, text, site, key), "lines")
    flagged = boilerplate(lines, min_sites)
    again = lines.join(flagged, ["h1", "h2"]).where((F.col("first.id") != F.col("id")) | (F.col("first.at") != F.col("at")))
    places = again.groupBy("id", "th").agg(F.sort_array(F.collect_set("at")).alias("at"))
    places = places.select(F.col("id").alias(own), F.col("th").alias(th), _flags("at").alias(gone), F.size("at").alias(many))
    keyed = docs.select(*keep, F.coalesce(F.col(key), F.lit(-(2**63))).alias(own), F.xxhash64(text).alias(th))
    out = keyed.join(places, [own, th], "left")
    split = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.zip_with(split, F.col(gone), lambda line, flag: F.when(flag.isNull() | ~flag, line)), "\n")  # nulls aren't joined
    texts = F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept).alias(text)
    n_lines = F.when(F.length(text) > 0, F.size(split)).otherwise(0).cast("long").alias("__n_lines")
    n_removed = F.coalesce(F.col(many), F.lit(0)).cast("long").alias("__n_removed")
    return out.select(*(texts if c == text else F.col(c) for c in keep), *[n_lines, n_removed][: len(made)])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs, counts=True).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


OP10_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), f AS (
  SELECT line, min((doc_id, pos)) AS first FROM l
  WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), k AS (
  SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AND f.first <> (l.doc_id, l.pos) AS gone
  FROM l LEFT JOIN f ON l.line = f.line
), c AS (
  SELECT doc_id, CAST(count_if(gone) AS BIGINT) AS n_removed, CAST(count(*) AS BIGINT) AS n_lines,
    string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN length(d.text) > 0 THEN c.n_lines ELSE 0 END AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id
"""
