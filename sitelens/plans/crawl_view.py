"""A crawl derived from the raw pages table, as the crawl tables that the operators take.

Pages, titles, texts and navigation links come from the HTML; what the raw table lacks (status, depth, targets of links) is
arithmetic on the page's id, so that the same crawl can be derived in any engine. crawl_sql() is the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seo import indexability
from ..functions.urls import directory_of, normalize_plain

NO_CODE = r"(?s)<head>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>"


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url", "html")
    return p.withColumn("normalized_url", normalize_plain(F.col("url"))).withColumn("url_hash", F.sha2("normalized_url", 256))


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_pages(spark, sf_dir)
    first = raw.groupBy("url_hash").agg(F.min("id").alias("id"))
    i = F.col("id")
    k = i % 20
    p = raw.join(first, ["url_hash", "id"], "left_semi")
    p = p.withColumn("title", F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), r"\s+", " ")), F.lit("")))
    p = p.withColumn("title", F.when(i % 37 == 6, F.repeat(F.concat("title", F.lit(" ")), 4)).when(i % 37 != 5, F.col("title")))
    p = p.withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("html", NO_CODE, ""), r"\s+", " ")))
    p = p.withColumn("h1", F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1), r"\s+", " ")), F.lit("")))
    p = p.withColumn("h1_count", F.when(i % 29 == 2, 0).when(i % 29 == 3, 2).otherwise(F.regexp_count("html", F.lit("<h1>")))).withColumn("h2_count", F.regexp_count("html", F.lit("<h2>"))).withColumn("language", F.regexp_extract("html", r'<html lang="([^"]*)"', 1))
    status = F.when(k == 7, 404).when(k == 8, 301).when(k == 9, 500).when(k == 19, None).otherwise(200)
    image = (i % 25 == 3) | (i % 50 == 27)
    p = p.withColumn("status_code", status.cast("int")).withColumn("content_type", F.when(image, "image/webp").otherwise("text/html; charset=utf-8"))
    s = F.col("status_code")
    kind = F.when(i % 50 == 11, None).when(s.isNull() | (s >= 400), "ERROR").when(s >= 300, "REDIRECT").when(image, "IMAGE").otherwise("HTML_PAGE")
    canonical = F.when(i % 4 == 0, None).when(i % 13 == 0, "https://other.example.com/").otherwise(F.col("normalized_url"))
    p = p.select(
        "*", F.lit("A").alias("crawl_id"), directory_of(F.col("normalized_url")).alias("directory"), F.length("title").alias("title_length"),
        F.when(i % 3 != 0, F.substring(F.repeat(F.concat(F.coalesce("title", F.lit("")), F.lit(" ")), 4), F.lit(1), (40 + i % 150).cast("int"))).alias("meta_description"),
        F.when(F.length("text") > 0, F.size(F.split("text", " "))).otherwise(0).alias("word_count"), F.when(F.length("text") > 0, F.sha2(F.when(i % 41 == 3, "one text").when(i % 82 == 9, "another").otherwise(F.col("text")), 256)).alias("content_hash"),
        kind.alias("resource_type"), F.when(image, "IMAGE").otherwise("HTML_PAGE").alias("media_type"), F.when(image, "image/webp").otherwise("text/html").alias("mime_type"), (i % 31 == 0).alias("mime_mismatch"),
        F.when(s.isNull(), F.when(i % 60 == 59, "BLOCKED_ROBOTS").when(i % 40 == 19, "TIMEOUT").otherwise("TOO_MANY_REDIRECTS")).alias("error_type"), F.when(s == 301, F.lit("https://example.org/new")).alias("redirect_url"),
        canonical.alias("canonical"), F.when(i % 17 == 0, "noindex, follow").alias("meta_robots"), F.lit(None).cast("string").alias("x_robots_tag"), (100 + i * 37 % 900).cast("int").alias("response_time"),
        (i % 7).cast("int").alias("depth"), (i % 3 == 0).alias("in_sitemap"), F.when(i == 0, "START").otherwise("LINK").alias("discovery_type"),
        (i % 5).cast("int").alias("images_count"), F.when(i % 5 > 2, i % 3).otherwise(0).cast("int").alias("images_missing_alt"), (i % 5 % 2).cast("int").alias("images_decorative"),
        ((i * 7919 % 1000) / 1000.0).cast("double").alias("internal_page_rank"),
    )
    p = p.withColumn("meta_description_length", F.length("meta_description"))
    reason = indexability(s, F.col("meta_robots"), F.col("x_robots_tag"), F.col("canonical"), F.col("normalized_url"), F.coalesce(F.col("error_type") == "BLOCKED_ROBOTS", F.lit(False)), ~image, F.col("error_type").isNotNull())
    return p.withColumn("indexability_reason", reason).withColumn("indexable", F.col("indexability_reason") == "INDEXABLE").withColumn("cluster_id", F.when(F.col("indexable"), i % 6).cast("int")).drop("html")


def crawl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation links; the target of a page's n-th link is another page by arithmetic, known by its URL hash."""
    raw = raw_pages(spark, sf_dir)
    size = raw.agg(F.count("*").alias("size"))
    anchors = raw.select(F.col("id").alias("source_page_id"), F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), 1)).alias("n", "anchor_text")).join(F.broadcast(size))  # one row
    s, n = F.col("source_page_id"), F.col("n")
    target = (s * 31 + (n + 1) * 17) % F.col("size")
    target = F.when(target % 23 == 5, (target + 1) % F.col("size")).otherwise(target)  # nobody links to some pages
    rows = anchors.withColumn("target_id", target).join(raw.select(F.col("id").alias("target_id"), F.col("normalized_url").alias("target_url"), F.col("url_hash").alias("target_hash")), "target_id")
    follow = (s + n) % 7 != 3
    return rows.select(
        (s * 100 + n).alias("id"), F.lit("A").alias("crawl_id"), "source_page_id", "target_url", "target_hash", F.substring("anchor_text", 1, 500).alias("anchor_text"),
        F.when(~follow, "nofollow").alias("rel"), F.when(n % 5 == 4, "EXTERNAL").otherwise("INTERNAL").alias("link_type"), follow.alias("follow"),
    )


LANGUAGES = ["es", "en-GB", "fr", "es_ES", "x-default", "english"]
SCHEMAS = [
    ("Article", '{"@type":"Article","headline":"a","author":"b"}'), ("Product", '{"@type":"Product","image":"a","offers":"b","description":"c"}'), ("Organization", '{"@type":"Organization","name":"a","url":"b","logo":"c"}'),
    ("Event", '{"@type":"Event","name":" ","startDate":"a"}'), (None, '{"@type":'), ("Thing", '{"@type":"Thing"}'), ("Event", '{"@graph":[{"@type":"Event","name":"a","startDate":"b"}]}'),
]


def _of_pages(pages: DataFrame, n: int, size: int, step: int) -> DataFrame:
    """page_id, n (from 0) and another page's id and URL for n things of each page, by arithmetic."""
    each = pages.select(F.col("id").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("n"))
    other = pages.select(F.col("id").alias("other_id"), F.col("normalized_url").alias("other_url"), F.col("url_hash").alias("other_hash"))
    return each.withColumn("other_id", (F.col("page_id") * size + F.col("n") * step + 1) % 97).join(other, "other_id", "left")


def crawl_images(pages: DataFrame) -> DataFrame:
    """Two images of each third page, whose own URLs are other pages'; some without alt, some with an empty one."""
    rows = _of_pages(pages, 2, 13, 5).where(F.col("page_id") % 3 == 1)
    k = (F.col("page_id") + F.col("n")) % 3
    return rows.select("page_id", "n", F.col("other_url").alias("src"), F.col("other_hash").alias("url_hash"), (k != 0).alias("has_alt"), F.when(k == 1, " ").when(k == 2, "photo").alias("alt"))


def crawl_hreflangs(pages: DataFrame) -> DataFrame:
    """Three alternates of each fourth page; some codes are none, some targets are broken, few link back."""
    rows = _of_pages(pages, 3, 1, 32).where(F.col("page_id") % 4 == 0)
    own = F.when(F.col("n") == F.col("page_id") % 3, F.lit(True))
    rows = rows.join(pages.select(F.col("id").alias("page_id"), F.col("normalized_url").alias("own_url")), "page_id")
    return rows.select("page_id", F.when(own, F.col("own_url")).otherwise(F.col("other_url")).alias("href"), F.element_at(F.array(*map(F.lit, LANGUAGES)), ((F.col("page_id") + F.col("n")) % 6 + 1).cast("int")).alias("language"))


def crawl_schemas(pages: DataFrame) -> DataFrame:
    """Structured data of each second page, whole, lacking and broken."""
    known = F.array(*(F.struct(F.lit(t).cast("string").alias("schema_type"), F.lit(raw).alias("raw_json"), F.lit(t is not None).alias("valid_json")) for t, raw in SCHEMAS))
    return pages.where(F.col("id") % 2 == 0).select(F.col("id").alias("page_id"), F.element_at(known, (F.col("id") / 2 % len(SCHEMAS) + 1).cast("int")).alias("x")).select("page_id", "x.*")


def second_crawl(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two crawls out of one: the base lacks some pages, the target others; some statuses and reasons differ."""
    i = F.col("id")
    base = pages.where(i % 13 != 4)
    status = F.when(i % 16 == 0, 404).when(i % 20 == 19, F.when(i % 3 == 0, 200)).otherwise(F.col("status_code")).cast("int")
    target = pages.where(i % 11 != 5).withColumn("status_code", status).withColumn("indexability_reason", F.when(i % 16 == 0, "CLIENT_ERROR").otherwise(F.col("indexability_reason")))
    return base, target


TRACKING_SQL = "('utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','gclid','gbraid','wbraid','fbclid','msclkid','mc_cid','mc_eid','_ga','_gl','yclid','igshid','ref_src')"

CRAWL_SQL = rf"""
raw0 AS (
  SELECT page_id AS id, url, html, regexp_replace(url, '#.*$', '') AS bare FROM pages
), raw1 AS (
  SELECT *, list_sort(list_transform(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN {TRACKING_SQL}),
    lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS q,
    regexp_extract(bare, '^[A-Za-z]+://[^/?]+([^?]*)', 1) AS pth
  FROM raw0
), raw AS (
  SELECT id, url, html, n AS normalized_url, sha256(n) AS url_hash FROM (
    SELECT *, lower(regexp_extract(bare, '^([A-Za-z]+://[^/?]+)', 1)) || CASE WHEN pth = '' THEN '/' ELSE pth END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS n FROM raw1)
), p1 AS (
  SELECT id, url, normalized_url, url_hash, CASE WHEN id % 37 = 6 THEN repeat(title0 || ' ', 4) WHEN id % 37 <> 5 THEN title0 END AS title,
    trim(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text,
    nullif(trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\s+', ' ', 'g')), '') AS h1,
    CASE WHEN id % 29 = 2 THEN 0 WHEN id % 29 = 3 THEN 2 ELSE len(regexp_extract_all(html, '<h1>')) END AS h1_count, len(regexp_extract_all(html, '<h2>')) AS h2_count, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language,
    string_split(trim(regexp_extract(normalized_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/') AS seg,
    CASE id % 20 WHEN 7 THEN 404 WHEN 8 THEN 301 WHEN 9 THEN 500 WHEN 19 THEN NULL ELSE 200 END AS status_code, (id % 25 = 3 OR id % 50 = 27) AS img
  FROM (SELECT *, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title0 FROM raw) raw WHERE id = (SELECT min(r.id) FROM raw r WHERE r.url_hash = raw.url_hash)
), p2 AS (
  SELECT *, 'A' AS crawl_id, CASE WHEN seg = [''] OR (len(seg) = 1 AND contains(seg[1], '.')) THEN '/' ELSE '/' || seg[1] END AS directory, length(title) AS title_length,
    CASE WHEN id % 3 <> 0 THEN substring(repeat(coalesce(title, '') || ' ', 4), 1, CAST(40 + id % 150 AS INT)) END AS meta_description,
    CASE WHEN length(text) > 0 THEN len(string_split(text, ' ')) ELSE 0 END AS word_count, CASE WHEN length(text) > 0 THEN sha256(CASE WHEN id % 41 = 3 THEN 'one text' WHEN id % 82 = 9 THEN 'another' ELSE text END) END AS content_hash,
    CASE WHEN img THEN 'image/webp' ELSE 'text/html; charset=utf-8' END AS content_type, CASE WHEN img THEN 'image/webp' ELSE 'text/html' END AS mime_type,
    CASE WHEN id % 50 = 11 THEN NULL WHEN status_code IS NULL OR status_code >= 400 THEN 'ERROR' WHEN status_code >= 300 THEN 'REDIRECT' WHEN img THEN 'IMAGE' ELSE 'HTML_PAGE' END AS resource_type,
    CASE WHEN img THEN 'IMAGE' ELSE 'HTML_PAGE' END AS media_type, id % 31 = 0 AS mime_mismatch,
    CASE WHEN status_code IS NULL THEN CASE WHEN id % 60 = 59 THEN 'BLOCKED_ROBOTS' WHEN id % 40 = 19 THEN 'TIMEOUT' ELSE 'TOO_MANY_REDIRECTS' END END AS error_type,
    CASE WHEN id % 4 = 0 THEN NULL WHEN id % 13 = 0 THEN 'https://other.example.com/' ELSE normalized_url END AS canonical, CASE WHEN id % 17 = 0 THEN 'noindex, follow' END AS meta_robots,
    100 + id * 37 % 900 AS response_time, id % 7 AS depth, id % 3 = 0 AS in_sitemap, CASE WHEN id = 0 THEN 'START' ELSE 'LINK' END AS discovery_type,
    id % 5 AS images_count, CASE WHEN id % 5 > 2 THEN id % 3 ELSE 0 END AS images_missing_alt, id % 5 % 2 AS images_decorative, CAST((id * 7919 % 1000) / 1000.0 AS DOUBLE) AS internal_page_rank
  FROM p1
), p3 AS (
  SELECT *, length(meta_description) AS meta_description_length,
    CASE WHEN error_type = 'BLOCKED_ROBOTS' THEN 'BLOCKED_ROBOTS' WHEN error_type IS NOT NULL OR status_code IS NULL THEN 'FETCH_ERROR' WHEN status_code >= 500 THEN 'SERVER_ERROR' WHEN status_code >= 400 THEN 'CLIENT_ERROR' WHEN status_code >= 300 THEN 'REDIRECT'
      WHEN img THEN 'UNSUPPORTED_CONTENT' WHEN meta_robots IS NOT NULL THEN 'NOINDEX' WHEN canonical <> normalized_url THEN 'CANONICALIZED' ELSE 'INDEXABLE' END AS indexability_reason
  FROM p2
), page AS (
  SELECT *, indexability_reason = 'INDEXABLE' AS indexable, CASE WHEN indexability_reason = 'INDEXABLE' THEN id % 6 END AS cluster_id FROM p3
), link0 AS (
  SELECT id AS s, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), 1) - 1 AS n FROM raw
), link1 AS (
  SELECT s * 100 + n AS id, 'A' AS crawl_id, s AS source_page_id, r.normalized_url AS target_url, r.url_hash AS target_hash, anchor AS anchor_text,
    CASE WHEN (s + n) % 7 = 3 THEN 'nofollow' END AS rel, CASE WHEN n % 5 = 4 THEN 'EXTERNAL' ELSE 'INTERNAL' END AS link_type, (s + n) % 7 <> 3 AS follow
  FROM (SELECT *, CASE WHEN t % 23 = 5 THEN (t + 1) % c ELSE t END AS target FROM (SELECT *, (s * 31 + (n + 1) * 17) % c AS t FROM link0, (SELECT count(*) AS c FROM raw))) JOIN raw r ON r.id = target
), link AS (
  SELECT l.*, p.id AS target_page_id FROM link1 l LEFT JOIN page p ON p.url_hash = l.target_hash
), inl AS (
  SELECT target_page_id AS id, count(*) AS internal_inlinks, count(DISTINCT source_page_id) AS unique_inlinks FROM link WHERE link_type = 'INTERNAL' AND target_page_id IS NOT NULL GROUP BY 1
), outl AS (
  SELECT source_page_id AS id, count_if(link_type = 'INTERNAL') AS internal_outlinks, count(DISTINCT CASE WHEN link_type = 'INTERNAL' THEN target_hash END) AS unique_outlinks, count_if(link_type = 'EXTERNAL') AS external_outlinks FROM link GROUP BY 1
), pm AS (
  SELECT page.*, coalesce(internal_inlinks, 0) AS internal_inlinks, coalesce(unique_inlinks, 0) AS unique_inlinks, coalesce(internal_outlinks, 0) AS internal_outlinks,
    coalesce(unique_outlinks, 0) AS unique_outlinks, coalesce(external_outlinks, 0) AS external_outlinks,
    in_sitemap AND coalesce(internal_inlinks, 0) = 0 AND discovery_type <> 'START' AS potential_orphan,
    coalesce((resource_type = 'HTML_PAGE' OR resource_type IS NULL AND NOT img) AND status_code BETWEEN 200 AND 299, false) AS a
  FROM page LEFT JOIN inl USING (id) LEFT JOIN outl USING (id)
)
"""

_LIST = "[" + ", ".join(f"'{x}'" for x in LANGUAGES) + "]"
_SCHEMA_VALUES = ", ".join(f"({k}, {'NULL' if t is None else repr(t)}, '{raw}', {t is not None})" for k, (t, raw) in enumerate(SCHEMAS))
#: Images, alternates and structured data of the pages.
CHILDREN_SQL = f""", img_ AS (
  SELECT p.id AS page_id, n, o.normalized_url AS src, o.url_hash, (p.id + n) % 3 <> 0 AS has_alt, CASE (p.id + n) % 3 WHEN 1 THEN ' ' WHEN 2 THEN 'photo' END AS alt
  FROM page p, range(0, 2) r(n) LEFT JOIN page o ON o.id = (p.id * 13 + n * 5 + 1) % 97 WHERE p.id % 3 = 1
), lang_ AS (
  SELECT p.id AS page_id, p.normalized_url AS page_url, CASE WHEN n = p.id % 3 THEN p.normalized_url ELSE o.normalized_url END AS href, {_LIST}[(p.id + n) % 6 + 1] AS language
  FROM page p, range(0, 3) r(n) LEFT JOIN page o ON o.id = (p.id + n * 32 + 1) % 97 WHERE p.id % 4 = 0
), schema_ AS (
  SELECT id AS page_id, normalized_url AS page_url, schema_type, raw_json, valid_json FROM page JOIN (VALUES {_SCHEMA_VALUES}) v(k, schema_type, raw_json, valid_json) ON k = id // 2 % {len(SCHEMAS)} WHERE id % 2 = 0
)"""

#: Code, severity and condition of the page rules.
RULES_SQL = [
    ("HTTP_5XX", "CRITICAL", "status_code >= 500"), ("HTTP_4XX", "HIGH", "status_code BETWEEN 400 AND 499"), ("FETCH_ERROR", "HIGH", "error_type NOT IN ('UNSUPPORTED_CONTENT', 'BLOCKED_ROBOTS')"),
    ("REDIRECT_LOOP", "CRITICAL", "error_type = 'TOO_MANY_REDIRECTS'"), ("REDIRECT", "MEDIUM", "status_code BETWEEN 300 AND 399"), ("NOINDEX", "HIGH", "a AND indexability_reason = 'NOINDEX'"),
    ("BLOCKED_ROBOTS", "HIGH", "indexability_reason = 'BLOCKED_ROBOTS'"), ("CANONICALIZED", "MEDIUM", "a AND indexability_reason = 'CANONICALIZED'"), ("MISSING_CANONICAL", "LOW", "a AND canonical IS NULL"),
    ("POTENTIAL_ORPHAN", "HIGH", "a AND potential_orphan"), ("MISSING_TITLE", "MEDIUM", "a AND title IS NULL"), ("TITLE_TOO_LONG", "LOW", "a AND title_length > 60"), ("TITLE_TOO_SHORT", "LOW", "a AND title_length BETWEEN 1 AND 19"),
    ("MISSING_DESCRIPTION", "MEDIUM", "a AND coalesce(trim(meta_description), '') = ''"), ("DESCRIPTION_TOO_LONG", "LOW", "a AND meta_description_length > 160"), ("DESCRIPTION_TOO_SHORT", "LOW", "a AND meta_description_length BETWEEN 1 AND 69"),
    ("MISSING_H1", "MEDIUM", "a AND h1_count <= 0"), ("MULTIPLE_H1", "MEDIUM", "a AND h1_count > 1"), ("DEEP_PAGE", "MEDIUM", "a AND indexable AND depth > 4"), ("LOW_INLINKS", "MEDIUM", "a AND indexable AND depth <> 0 AND internal_inlinks < 2"),
    ("THIN_CONTENT", "LOW", "a AND indexable AND word_count < 200"), ("IMAGES_MISSING_ALT", "LOW", "a AND images_missing_alt > 0"), ("IMAGES_DECORATIVE_ALT", "INFO", "a AND images_decorative > 0"),
    ("MIME_MISMATCH", "LOW", "mime_mismatch AND status_code < 300"), ("BROKEN_ASSET", "MEDIUM", "media_type = 'IMAGE' AND error_type IS DISTINCT FROM 'BLOCKED_ROBOTS' AND (status_code IS NULL OR status_code >= 400)"),
]

FINDINGS_SQL = CRAWL_SQL + ", finding AS (" + " UNION ALL ".join(f"SELECT id AS page_id, normalized_url AS url, '{c}' AS code, '{s}' AS severity FROM pm WHERE {w}" for c, s, w in RULES_SQL) + ")"


def crawl_sql(select: str, findings: bool = False) -> str:
    return f"WITH {FINDINGS_SQL if findings else CRAWL_SQL} {select}"
