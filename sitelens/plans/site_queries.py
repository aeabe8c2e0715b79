"""More named queries: images, alternates, structured data, whole reports, trees, keyword jobs, site files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.lineage import cut, shared_dir
from ..operators import bucket_table, compare, inventory, keyword_import, keywords, links, rules, sinks, stats, text_index, trees
from ..sources import crawl_store, search_api
from . import crawl_document
from .crawl_view import CHILDREN_SQL, crawl_hreflangs, crawl_images, crawl_links, crawl_pages, crawl_schemas, crawl_sql, second_crawl
from .registry import query, table


def _narrow(spark: SparkSession, d: str) -> DataFrame:
    return cut(crawl_pages(spark, d).drop("text"), "pages")


def _crawl(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = cut(links.resolve_targets(crawl_links(spark, d), crawl_pages(spark, d)), "links")
    return cut(links.with_link_metrics(crawl_pages(spark, d).drop("text"), edges), "pages"), edges


# Images, alternates, structured data

_HTML = "coalesce(resource_type, 'HTML_PAGE') = 'HTML_PAGE'"


@query("image_stats", crawl_sql(CHILDREN_SQL + f"""SELECT *, CASE WHEN elements > 0 THEN round(missing_alt / elements, 4) ELSE 0.0 END AS missing_alt_ratio FROM (SELECT count(*) AS elements, count_if(NOT has_alt) AS missing_alt, count_if(has_alt AND trim(coalesce(alt, '')) = '') AS decorative_alt,
  count_if(has_alt AND trim(coalesce(alt, '')) <> '') AS described_alt, count(DISTINCT CASE WHEN NOT has_alt THEN page_id END) AS pages_with_missing_alt FROM img_ WHERE page_id IN (SELECT id FROM page WHERE {_HTML}))"""))
def _(spark, d):
    p = _narrow(spark, d)
    return stats.image_stats(crawl_images(p), p)


@query("broken_images", crawl_sql(CHILDREN_SQL + """SELECT s.id AS page_id, s.normalized_url AS source_url, t.normalized_url AS image_url, t.status_code, count(*) AS appearances FROM img_ i JOIN page s ON s.id = i.page_id AND s.resource_type = 'HTML_PAGE' JOIN page t ON t.url_hash = i.url_hash AND (t.status_code >= 400 OR t.status_code IS NULL) GROUP BY 1, 2, 3, 4"""))
def _(spark, d):
    p = _narrow(spark, d)
    return links.broken_images(crawl_images(p), p)


@query("image_export", crawl_sql(CHILDREN_SQL + """SELECT s.normalized_url AS page_url, coalesce(src, '') AS src, CASE WHEN NOT has_alt THEN 'MISSING' WHEN trim(coalesce(alt, '')) = '' THEN 'DECORATIVE' ELSE 'DESCRIPTIVE' END AS alt_state, coalesce(alt, '') AS alt, coalesce(CAST(t.status_code AS VARCHAR), '') AS image_status
  FROM img_ i JOIN page s ON s.id = i.page_id LEFT JOIN page t ON t.url_hash = i.url_hash"""))
def _(spark, d):
    p = _narrow(spark, d)
    absent = [F.lit(None).cast("string").alias(c) for c in ("width", "height", "loading", "srcset")]
    return sinks.images_csv(crawl_images(p).select("*", *absent), p).drop("width", "height", "loading", "srcset")


_VALID = r"(lower(trim(language)) = 'x-default' OR regexp_full_match(trim(language), '[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?'))"


@query("hreflang_findings", crawl_sql(CHILDREN_SQL + rf""", away AS (SELECT DISTINCT page_id, page_url, href, n FROM (SELECT *, count(*) OVER (PARTITION BY page_id, href) AS n FROM lang_ WHERE href IS NOT NULL AND href <> page_url)), bad AS (
  SELECT a.page_id, a.page_url, a.href || ' (' || coalesce(CAST(t.status_code AS VARCHAR), 'sin respuesta') || ')' AS x, n FROM away a JOIN page t ON t.normalized_url = a.href WHERE t.status_code IS NULL OR t.status_code >= 300), one_way AS (
  SELECT page_id, page_url, href, n FROM away a WHERE href IN (SELECT page_url FROM lang_) AND NOT EXISTS (SELECT 1 FROM lang_ b WHERE b.page_url = a.href AND b.href = a.page_url))
  SELECT page_id, 'HREFLANG_INVALID_CODE' AS code, 'MEDIUM' AS severity, string_agg(language, ', ' ORDER BY language) AS details FROM lang_ WHERE NOT {_VALID} GROUP BY 1
  UNION ALL SELECT page_id, 'HREFLANG_MISSING_SELF', 'MEDIUM', 'El conjunto no incluye una etiqueta que apunte a esta misma URL' FROM lang_ GROUP BY page_id, page_url HAVING NOT bool_or(coalesce(href = page_url, false))
  UNION ALL SELECT page_id, 'HREFLANG_BROKEN_TARGET', 'HIGH', array_to_string((list_sort(flatten(list(list_resize([x], CAST(n AS INT), x)))))[1:5], ' · ') FROM bad GROUP BY page_id
  UNION ALL SELECT page_id, 'HREFLANG_NOT_RECIPROCAL', 'MEDIUM', array_to_string((list_sort(flatten(list(list_resize([href], CAST(n AS INT), href)))))[1:5], ' · ') FROM one_way GROUP BY page_id"""))
def _(spark, d):
    p = _narrow(spark, d)
    return rules.hreflang_findings(crawl_hreflangs(p), p).select("page_id", "code", "severity", "details")


@query("schema_findings", crawl_sql(CHILDREN_SQL + """SELECT page_id, page_url AS url, 'SCHEMA_INVALID_JSON' AS code, 'MEDIUM' AS severity, NULL AS details FROM schema_ WHERE NOT valid_json
  UNION ALL SELECT page_id, page_url, c, s, schema_type || ': ' || m FROM schema_ JOIN (VALUES ('Article', 'SCHEMA_MISSING_RECOMMENDED', 'LOW', 'image, datePublished, dateModified'), ('Product', 'SCHEMA_MISSING_REQUIRED', 'MEDIUM', 'name'),
    ('Event', 'SCHEMA_MISSING_RECOMMENDED', 'LOW', 'location, endDate')) v(t, c, s, m) ON t = schema_type
  UNION ALL SELECT page_id, page_url, 'SCHEMA_MISSING_REQUIRED', 'MEDIUM', 'Event: name' FROM schema_ WHERE schema_type = 'Event' AND json_extract_string(raw_json, '$.name') = ' '"""))
def _(spark, d):
    p = _narrow(spark, d)
    return rules.schema_findings(crawl_schemas(p), p).select("page_id", "url", "code", "severity", "details")


@query("schema_coverage", crawl_sql(CHILDREN_SQL + "SELECT schema_type, count(DISTINCT page_id) AS pages FROM schema_ WHERE schema_type IS NOT NULL GROUP BY 1"))
def _(spark, d):
    p = _narrow(spark, d)
    return inventory.schema_coverage(crawl_schemas(p), p)


@query("broken_link_findings", crawl_sql("""SELECT s.id AS page_id, 'BROKEN_INTERNAL_LINK' AS code, '→ ' || t.normalized_url || ' (' || t.status_code || ')' || CASE WHEN substring(anchor_text, 1, 120) <> '' THEN ' · anchor: "' || substring(anchor_text, 1, 120) || '"' ELSE '' END AS details
  FROM link l JOIN page s ON s.id = l.source_page_id JOIN page t ON t.id = l.target_page_id WHERE link_type = 'INTERNAL' AND t.status_code >= 400"""))
def _(spark, d):
    p, edges = _crawl(spark, d)
    return rules.broken_link_findings(edges, p).select("page_id", "code", "details")


@query("duplicate_titles_top", crawl_sql("SELECT substring(title, 1, 150) AS value, count(*) AS pages FROM page WHERE indexable AND title <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 15"))
def _(spark, d):
    return inventory.duplicate_values(crawl_pages(spark, d), "title")


# Inventory and tools


@query("redirects", crawl_sql("SELECT id, normalized_url, internal_inlinks FROM pm WHERE status_code BETWEEN 300 AND 399 ORDER BY internal_inlinks DESC, id LIMIT 20"))
def _(spark, d):
    return inventory.redirects(_crawl(spark, d)[0]).select("id", "normalized_url", "internal_inlinks")


@query("orphan_pages", crawl_sql("SELECT id, normalized_url FROM pm WHERE potential_orphan ORDER BY id LIMIT 25"))
def _(spark, d):
    return inventory.orphan_pages(_crawl(spark, d)[0]).select("id", "normalized_url")


@query("canonicalized_pages", crawl_sql("SELECT id, canonical FROM page WHERE indexability_reason = 'CANONICALIZED' ORDER BY id LIMIT 20"))
def _(spark, d):
    return inventory.canonicalized(crawl_pages(spark, d)).select("id", "canonical")


@query("links_from_page", crawl_sql("SELECT l.id, target_url, t.status_code FROM link l LEFT JOIN page t ON t.id = l.target_page_id WHERE source_page_id = 1 ORDER BY l.id LIMIT 500"))
def _(spark, d):
    p, edges = _crawl(spark, d)
    return inventory.links_from(p, edges, 1).select("id", "target_url", "status_code")


@query("asset_inventory", crawl_sql(f"SELECT id, resource_type FROM page WHERE NOT ({_HTML})"))
def _(spark, d):
    return inventory.page_filter(crawl_pages(spark, d), kind="assets").select("id", "resource_type")


@query("subgraph_nodes", crawl_sql("SELECT id FROM pm ORDER BY internal_page_rank DESC, internal_inlinks DESC, id LIMIT 50"))
def _(spark, d):
    return inventory.subgraph(*_crawl(spark, d), limit=50)[0].select("id")


@query("subgraph_edges", crawl_sql(""", n AS (SELECT id FROM pm ORDER BY internal_page_rank DESC, internal_inlinks DESC, id LIMIT 50)
  SELECT source_page_id AS src, target_page_id AS dst FROM link WHERE target_page_id IS NOT NULL AND source_page_id <> target_page_id AND source_page_id IN (SELECT id FROM n) AND target_page_id IN (SELECT id FROM n) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 600"""))
def _(spark, d):
    return inventory.subgraph(*_crawl(spark, d), limit=50)[1].select("src", "dst")


@query("page_details", crawl_sql(CHILDREN_SQL + """SELECT part, n FROM (SELECT 'page' AS part, count(*) AS n FROM page WHERE id = 4 UNION ALL SELECT 'issues', count(*) FROM finding WHERE page_id = 4 UNION ALL SELECT 'inlinks', least(200, count(*)) FROM link WHERE target_page_id = 4
  UNION ALL SELECT 'outlinks', least(500, count(*)) FROM link WHERE source_page_id = 4 UNION ALL SELECT 'images', count(*) FROM img_ WHERE page_id = 4 UNION ALL SELECT 'hreflangs', count(*) FROM lang_ WHERE page_id = 4 UNION ALL SELECT 'schemas', count(*) FROM schema_ WHERE page_id = 4)""", True))
def _(spark, d):
    p, edges = _crawl(spark, d)
    found = inventory.page_details(4, p, edges, rules.page_findings(p), images=crawl_images(p), hreflangs=crawl_hreflangs(p), schemas=crawl_schemas(p))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n") for part, df in found.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("crawl_summary", crawl_sql(f"""SELECT 'status' AS part, CASE WHEN status_code IS NULL THEN 'error' WHEN status_code < 300 THEN '2xx' WHEN status_code < 400 THEN '3xx' WHEN status_code < 500 THEN '4xx' ELSE '5xx' END AS key, CAST(count(*) AS DOUBLE) AS value FROM page GROUP BY 2
  UNION ALL SELECT 'reason', indexability_reason, count(*) FROM page WHERE {_HTML} GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM finding GROUP BY 2
  UNION ALL SELECT 'totals', 'requested_urls', count(*) FROM page UNION ALL SELECT 'links', 'internal', count_if(link_type = 'INTERNAL') FROM link""", True))
def _(spark, d):
    p, edges = _crawl(spark, d)
    every = inventory.crawl_summary(p, edges, rules.page_findings(p))
    return every.where(F.col("part").isin("status", "reason", "severity") | F.col("key").isin("requested_urls") | (F.col("part") == "links") & (F.col("key") == "internal"))


@query("workspace_totals", "SELECT 'projects' AS what, count(*) AS count FROM nation UNION ALL SELECT 'crawls', count(*) FROM customer UNION ALL SELECT 'pages', count(*) FROM orders UNION ALL SELECT 'issues', count(*) FROM lineitem")
def _(spark, d):
    return inventory.workspace_totals(*(table(spark, d, t) for t in ("nation", "customer", "orders", "lineitem")))


@query("report_list", "SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS score FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' AND c_nationkey = 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(spark, d):
    reports = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("m").alias("model"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("crawl_id"), F.when(F.col("o_orderstatus") == "F", "failed").alias("error"),
        F.concat(F.lit('{"summary":"s","score":'), F.col("o_totalprice").cast("string"), F.lit("}")).alias("output"),
    )
    crawls = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"), F.lit("u").alias("start_url"), F.lit(1).alias("crawled_urls"), F.lit(None).cast("timestamp").alias("completed_at"))
    return inventory.report_list(reports, crawls, 3, kind="1-URGENT").select("id", "score")


# Two crawls as a whole

_HEALTH = "greatest(0, least(100, floor(100 - coalesce((SELECT sum(CAST(CASE severity WHEN 'CRITICAL' THEN 12 WHEN 'HIGH' THEN 6 WHEN 'MEDIUM' THEN 2.5 WHEN 'LOW' THEN 0.8 ELSE 0 END AS DOUBLE)) FROM finding WHERE page_id IN (SELECT id FROM {x})) / count_if(h), 0) + 0.5)))"
_SIDES = (
    ", a AS (SELECT * FROM page WHERE id % 13 <> 4), b AS (SELECT * REPLACE (CASE WHEN id % 16 = 0 THEN 404 WHEN id % 20 = 19 THEN CASE WHEN id % 3 = 0 THEN 200 END ELSE status_code END AS status_code) FROM page WHERE id % 11 <> 5), "
    + ", ".join(
        f"m{x} AS (SELECT count(*) AS crawled_urls, count_if(h AND indexable) AS indexable, count_if(h AND status_code >= 400) AS errors, count_if(status_code BETWEEN 300 AND 399) AS redirects, (SELECT count_if(link_type = 'INTERNAL') FROM link WHERE source_page_id IN (SELECT id FROM {x})) AS internal_links,"
        f" round(avg(depth) FILTER (WHERE h), 2) AS average_depth, {_HEALTH.format(x=x)} AS seo_health, 0 AS geo_readiness, (SELECT count(*) FROM finding WHERE page_id IN (SELECT id FROM {x})) AS issues FROM (SELECT *, {_HTML} AS h FROM {x}))"
        for x in "ab"
    )
)


def _compared(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The two derived crawls under ids of their own, compared."""
    p, edges = _crawl(spark, d)
    found = cut(rules.page_findings(p), "findings")
    base, target = second_crawl(p)
    shift = 1 << 40
    pages = cut(base.withColumn("crawl_id", F.lit("A")).unionByName(target.withColumns({"crawl_id": F.lit("B"), "id": F.col("id") + shift})), "two-crawls")
    both = lambda df, key: df.unionByName(df.withColumn(key, F.col(key) + shift))
    crawls = spark.createDataFrame([("A", 1), ("B", 1)], "id string, project_id int")
    return compare.compare_crawls("A", "B", crawls, pages, both(edges, "source_page_id"), both(found, "page_id"))


@query("compare_metrics", crawl_sql(_SIDES + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST(ma.{m} AS DOUBLE) AS before, CAST(mb.{m} AS DOUBLE) AS after, CAST(mb.{m} AS DOUBLE) - CAST(ma.{m} AS DOUBLE) AS delta, {str(up).lower()} AS higher_is_better FROM ma, mb" for m, up in compare.METRICS.items()), True))
def _(spark, d):
    return _compared(spark, d)["metrics"]


@query("compare_issue_deltas", crawl_sql(", f AS (SELECT code, count_if(page_id % 13 <> 4) AS before, count_if(page_id % 11 <> 5) AS after FROM finding GROUP BY 1) SELECT code, before, after, after - before AS delta FROM f WHERE after <> before", True))
def _(spark, d):
    return _compared(spark, d)["issue_deltas"]


# Trees and sections

_SILO = """, k AS (SELECT *, CASE WHEN len(seg) <= 1 THEN '/' ELSE '/' || seg[1] END AS silo FROM pm WHERE resource_type = 'HTML_PAGE' AND NOT contains(normalized_url, '/cdn-cgi')), f AS (
  SELECT a.silo AS from_silo, b.silo AS to_silo, count(*) AS links FROM link l JOIN k a ON a.id = l.source_page_id JOIN k b ON b.id = l.target_page_id WHERE link_type = 'INTERNAL' AND l.source_page_id <> l.target_page_id GROUP BY 1, 2)"""


@query("silo_flows", crawl_sql(_SILO + " SELECT * FROM f"))
def _(spark, d):
    return trees.silo_report(*_crawl(spark, d))["flows"]


@query("silo_totals", crawl_sql(_SILO + """, s AS (SELECT CAST(sum(links) AS BIGINT) AS internal_links, CAST(coalesce(sum(links) FILTER (WHERE from_silo <> to_silo), 0) AS BIGINT) AS cross_silo_links FROM f)
  SELECT (SELECT count(*) FROM page) AS total_pages, (SELECT count(*) FROM k) AS analyzed_pages, internal_links, cross_silo_links, round(1 - cross_silo_links / internal_links, 9) AS cohesion, false AS flat_site FROM s"""))
def _(spark, d):
    return trees.silo_report(*_crawl(spark, d))["totals"].withColumn("cohesion", F.round("cohesion", 9))


@query("silo_top_pages", crawl_sql(_SILO + " SELECT silo, place, id FROM (SELECT silo, id, row_number() OVER (PARTITION BY silo ORDER BY internal_inlinks DESC, internal_page_rank DESC, id) AS place FROM k) WHERE place <= 10"))
def _(spark, d):
    return trees.silo_report(*_crawl(spark, d))["top_pages"].select("silo", "place", "id")


@query("silo_findings", crawl_sql(_SILO + """, z AS (SELECT silo, count(*) AS pages, count_if(potential_orphan) AS orphans, max(internal_inlinks) AS hub, max(internal_inlinks) FILTER (WHERE lower(rtrim(regexp_extract(normalized_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')) = lower(rtrim(silo, '/'))) AS head FROM k GROUP BY 1),
  y AS (SELECT z.*, coalesce((SELECT sum(links) FROM f WHERE from_silo = silo AND to_silo = silo), 0) AS w, coalesce((SELECT sum(links) FROM f WHERE from_silo = silo AND to_silo <> silo), 0) AS o, coalesce((SELECT sum(links) FROM f WHERE from_silo <> silo AND to_silo = silo), 0) AS i FROM z WHERE pages >= 3)
  SELECT 'NO_HEAD' AS code, silo FROM y WHERE silo <> '/' AND head IS NULL UNION ALL SELECT 'WEAK_HEAD', silo FROM y WHERE head < hub UNION ALL SELECT 'LEAKING', silo FROM y WHERE w + o > 0 AND w / (w + o) < 0.5
  UNION ALL SELECT 'NOT_LINKED', silo FROM y WHERE silo <> '/' AND i = 0 UNION ALL SELECT 'ORPHANS', silo FROM y WHERE orphans > 0 UNION ALL SELECT 'FLOW', silo FROM y JOIN f ON from_silo = silo AND to_silo <> silo AND links > w"""))
def _(spark, d):
    return trees.silo_report(*_crawl(spark, d))["findings"].select("code", "silo")


@query("tree_counts", crawl_sql("SELECT count(*) AS total, least(40, count(*)) AS rendered, count(*) > 40 AS truncated FROM page WHERE status_code BETWEEN 200 AND 299"))
def _(spark, d):
    return trees.build_tree(*_crawl(spark, d), limit=40, status="2xx")["counts"]


@query("inlink_tree", crawl_sql("").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, e AS (SELECT DISTINCT target_page_id AS src, source_page_id AS dst FROM link WHERE link_type = 'INTERNAL' AND target_page_id IS NOT NULL AND source_page_id <> target_page_id),
  b(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.id WHERE b.depth < 4) SELECT id, min(depth) AS depth FROM b GROUP BY 1""")
def _(spark, d):
    return trees.inlink_tree(*_crawl(spark, d), 1).select("id", "depth")


# Keyword jobs: parts as keywords, line items as their measurements

def _es(n: str) -> str:
    return f"CASE WHEN abs({n}) < 10000 THEN CAST(CAST(round({n}) AS BIGINT) AS VARCHAR) ELSE replace(format('{{:,}}', CAST(round({n}) AS BIGINT)), ',', '.') END"


def _lines(section: int, source: str, pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {section} AS section, {k} AS place, '{name}' || ' | ' || {value} AS line FROM {source}" for k, (name, value) in enumerate(pairs))


def _counts(section: int, source: str) -> str:
    return f"SELECT {section}, row_number() OVER (ORDER BY n DESC, try_cast(key AS DOUBLE) NULLS FIRST, key NULLS FIRST) - 1, coalesce(key, 'null') || ' | ' || {_es('n')} FROM ({source} GROUP BY 1)"


_DOCUMENT = crawl_sql(CHILDREN_SQL + f""", tot AS (SELECT count(*) AS requested, count_if({_HTML}) AS html, count_if({_HTML} AND indexable) AS ok, count_if({_HTML} AND status_code >= 400) AS errors, count_if(status_code BETWEEN 300 AND 399) AS moved, avg(depth) FILTER (WHERE {_HTML}) AS deep,
    round(avg(response_time) FILTER (WHERE {_HTML})) AS ms, round(avg(word_count) FILTER (WHERE {_HTML})) AS words, (SELECT count_if(link_type = 'INTERNAL') FROM link) AS inner_, (SELECT count_if(link_type = 'EXTERNAL') FROM link) AS outer_,
    count_if(media_type = 'IMAGE') AS images, count_if(media_type = 'IMAGE' AND (status_code IS NULL OR status_code >= 400)) AS broken, count_if(mime_mismatch) AS odd,
    (SELECT greatest(0, least(100, floor(100 - sum(CAST(CASE severity WHEN 'CRITICAL' THEN 12 WHEN 'HIGH' THEN 6 WHEN 'MEDIUM' THEN 2.5 WHEN 'LOW' THEN 0.8 ELSE 0 END AS DOUBLE)) / (SELECT count_if({_HTML}) FROM page) + 0.5))) FROM finding) AS health FROM page),
  im AS (SELECT count(*) AS e, count_if(NOT has_alt) AS missing, count_if(has_alt AND trim(coalesce(alt, '')) = '') AS blank, count_if(has_alt AND trim(coalesce(alt, '')) <> '') AS told, count(DISTINCT CASE WHEN NOT has_alt THEN page_id END) AS on_pages FROM img_ WHERE page_id IN (SELECT id FROM page WHERE {_HTML})),
  flow AS (SELECT t.cluster_id, count(*) AS n FROM link l JOIN page s ON s.id = l.source_page_id JOIN page t ON t.id = l.target_page_id WHERE link_type = 'INTERNAL' AND s.cluster_id <> t.cluster_id GROUP BY 1),
  cl AS (SELECT cluster_id, count(*) AS n, avg(depth) AS deep, arg_max(normalized_url, (internal_page_rank, -id)) AS top FROM page WHERE cluster_id IS NOT NULL GROUP BY 1),
  res AS (SELECT 0 AS a, 0 AS b, 'Recursos (no HTML)' AS k, {_es('requested - html')} AS v FROM tot UNION ALL SELECT 1, -count(*), '· ' || coalesce(resource_type, 'UNKNOWN'), {_es('count(*)')} FROM page WHERE resource_type IS DISTINCT FROM 'HTML_PAGE' GROUP BY resource_type UNION ALL SELECT 2, 0, 'Imágenes solicitadas', {_es('images')} FROM tot
    UNION ALL SELECT 3, 0, 'Imágenes rotas', {_es('broken')} || format(' ({{:.1f}}% de las imágenes solicitadas)', round(broken / images, 4) * 100) FROM tot UNION ALL SELECT 4, 0, 'Recursos rotos', {_es('broken')} FROM tot UNION ALL SELECT 5, 0, 'Extensión ≠ Content-Type', {_es('odd')} FROM tot)
  """ + " UNION ALL ".join([
    _lines(0, "tot", [("Páginas HTML", _es("html")), ("SEO Health", "format('{:.0f}/100', health)")]),
    _lines(1, "tot", [("Páginas HTML analizadas", _es("html")), ("URLs solicitadas (con recursos)", _es("requested")), ("Indexables", _es("ok")), ("No indexables", _es("html - ok")), ("Errores", _es("errors")), ("Redirecciones", _es("moved")), ("Enlaces internos", _es("inner_")), ("Enlaces externos", _es("outer_")),
                      ("Profundidad media", "format('{:.1f}', round(round(deep, 2), 1))"), ("Tiempo de respuesta medio", _es("ms") + " || ' ms'"), ("Palabras por página (media)", _es("words"))]),
    "SELECT 2, row_number() OVER (ORDER BY a, b, k) - 1, k || ' | ' || v FROM res",
    _lines(3, "im", [("Elementos <img> auditados", _es("e")), ("Sin atributo alt", _es("missing") + " || format(' ({:.1f}% de los <img> auditados)', round(missing / e, 4) * 100)"), ('Decorativas (alt="")', _es("blank") + " || ' · válido, sólo informativo'"), ("Con alt descriptivo", _es("told")), ("Páginas afectadas por imágenes sin alt", _es("on_pages"))]),
    _counts(4, "SELECT CASE WHEN status_code IS NULL THEN 'error' WHEN status_code < 300 THEN '2xx' WHEN status_code < 400 THEN '3xx' WHEN status_code < 500 THEN '4xx' ELSE '5xx' END AS key, count(*) AS n FROM page"),
    _counts(5, f"SELECT CAST(depth AS VARCHAR) AS key, count(*) AS n FROM page WHERE {_HTML}"), _counts(6, f"SELECT indexability_reason AS key, count(*) AS n FROM page WHERE {_HTML}"),
    f"SELECT 7, row_number() OVER (ORDER BY n DESC, code) - 1, severity || ' | ' || code || ' | ' || {_es('n')} FROM (SELECT code, min(severity) AS severity, count(*) AS n FROM finding GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 25)",
    f"SELECT 8, row_number() OVER (ORDER BY n DESC, directory) - 1, directory || ' | ' || {_es('n')} || ' | ' || {_es('ok')} FROM (SELECT directory, count(*) AS n, count_if(indexable) AS ok FROM page WHERE {_HTML} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25)",
    f"SELECT 10, 0, {_es('count(*)')} || ' comunidad(es) detectada(s).' FROM cl",
    f"SELECT 11, row_number() OVER (ORDER BY cl.n DESC, cluster_id) - 1, cluster_id || ' | ' || {_es('cl.n')} || ' | ' || top || ' | ' || format('{{:.1f}}', round(deep, 1)) || ' | ' || {_es('coalesce(flow.n, 0)')} FROM cl LEFT JOIN flow USING (cluster_id)",
]), findings=True)


@query("crawl_document", _DOCUMENT)
def _(spark, d):
    p, edges = _crawl(spark, d)
    found = cut(rules.page_findings(p), "findings")
    analysis = {
        "stats": stats.crawl_stats(p, edges, found), "top_issues": stats.top_issues(found), "directories": stats.directory_stats(p), "images": stats.image_stats(crawl_images(p), p), "clusters": stats.cluster_summary(p), "cluster_inbound": stats.cluster_inbound(edges, p),
    }
    rows = crawl_document.document_rows(analysis)
    untitled = F.when(F.col("heading") == "Incidencias detectadas", F.array_remove("cells", F.col("cells")[1])).otherwise(F.col("cells"))  # titles are the rules' own
    return rows.select("section", "place", F.array_join(untitled, " | ").alias("line"))


_RANKS = "r AS (SELECT p_name AS query, l_suppkey, avg(l_quantity) AS position, CAST(sum(l_linenumber) AS DOUBLE) + 0.4 AS clicks, sum(l_linenumber) * 10.0 AS impressions FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2)"
_BEST = "best AS (SELECT query, round(min(position), 6) AS position, arg_min(l_suppkey, (position, l_suppkey)) AS s, CAST(round(arg_min(clicks, (position, l_suppkey))) AS BIGINT) AS clicks FROM r GROUP BY 1)"


def _keyword_table(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("keyword_id"), F.col("p_name").alias("keyword"), F.col("p_name").alias("normalized"), (F.col("p_partkey") % 2 == 0).alias("tracked"), F.lit("CSV").alias("source"), F.col("p_brand").alias("tags"),
        F.when(F.col("p_partkey") % 3 == 0, (F.col("p_size") * 1.0)).alias("last_position"), F.lit(None).cast("double").alias("previous_position"), F.when(F.col("p_partkey") % 3 == 0, F.lit(20.0)).alias("best_position"),
        F.lit(0).cast("long").alias("last_clicks"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("long")).alias("last_impressions"), F.lit("").alias("last_url"),
    )


def _tracked(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    li = table(spark, d, "lineitem").where(F.col("l_suppkey") % 5 != 0).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    analytics = li.groupBy(F.col("p_name").alias("query"), F.col("l_suppkey").alias("input_order")).agg(F.avg("l_quantity").alias("position"), (F.sum("l_linenumber").cast("double") + 0.4).alias("clicks"), (F.sum("l_linenumber") * 10.0).alias("impressions"), F.lit(0.1).alias("ctr"))
    analytics = analytics.withColumn("page", F.concat(F.lit("/s/"), "input_order"))
    before = _keyword_table(spark, d).where("keyword_id % 10 = 0").select("keyword_id", F.to_date(F.lit("2024-01-07")).alias("date"), F.lit(50.0).alias("position"), F.lit(1).cast("long").alias("clicks"), F.lit(1).cast("long").alias("impressions"), F.lit(0.0).alias("ctr"), F.lit("/old").alias("url"))
    return keywords.track_day(_keyword_table(spark, d), analytics, before, F.to_date(F.lit("2024-01-10")))


@query("track_day_history", f"""WITH {_RANKS}, {_BEST} SELECT p_partkey AS keyword_id, '2024-01-07' AS date, CASE WHEN b.query IS NOT NULL THEN b.position WHEN p_partkey % 10 = 0 THEN 50.0 END AS position, CASE WHEN b.query IS NOT NULL THEN b.clicks WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS clicks,
  CASE WHEN b.query IS NOT NULL THEN '/s/' || s WHEN p_partkey % 10 = 0 THEN '/old' END AS url FROM part LEFT JOIN best b ON b.query = p_name WHERE p_partkey % 2 = 0""")
def _(spark, d):
    return _tracked(spark, d)["history"].select("keyword_id", F.col("date").cast("string").alias("date"), F.round("position", 6).alias("position"), "clicks", "url")


@query("track_day_keywords", f"""WITH {_RANKS}, {_BEST}, k AS (SELECT *, p_partkey % 2 = 0 AND b.query IS NOT NULL AS hit FROM part LEFT JOIN best b ON b.query = p_name)
  SELECT p_partkey AS keyword_id, CASE WHEN hit THEN position WHEN p_partkey % 3 = 0 THEN p_size END AS last_position, CASE WHEN hit AND p_partkey % 3 = 0 THEN p_size END AS previous_position, CASE WHEN hit THEN least(CASE WHEN p_partkey % 3 = 0 THEN 20.0 END, position) WHEN p_partkey % 3 = 0 THEN 20.0 END AS best_position FROM k""")
def _(spark, d):
    return _tracked(spark, d)["keywords"].select("keyword_id", F.round("last_position", 6).alias("last_position"), "previous_position", F.round("best_position", 6).alias("best_position"))


@query("track_day_counters", f"WITH {_RANKS} SELECT count(*) AS processed, count_if(p_name IN (SELECT query FROM r)) AS matched FROM part WHERE p_partkey % 2 = 0")
def _(spark, d):
    return _tracked(spark, d)["counters"]


@query("keyword_list", "SELECT p_partkey AS keyword_id, p_name AS keyword, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS last_impressions FROM part WHERE contains(lower(p_name), 'widget') AND p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_size <= 30")
def _(spark, d):
    return keywords.keyword_list(_keyword_table(spark, d), search="Widget", tracked=True, bucket="top30").select("keyword_id", "keyword", "last_impressions")


def _checked(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("v"))
    k = e.select(F.col("user_id").alias("keyword_id"), (F.col("user_id") % 3).alias("project_id"), *(F.lit(x).cast("int").alias(c) for c, x in (("serp_position", 9), ("serp_previous_position", None), ("serp_best_position", 4))), F.lit("").alias("serp_url"))
    found = F.col("n") % 2 == 0
    answers = e.select(F.col("user_id").alias("keyword_id"), found.alias("found"), F.when(found, F.col("n") % 10 + 1).cast("int").alias("rank"), F.when(found, "/u").alias("rank_url"), F.lit(0.005).alias("cost_usd"), F.when(F.col("user_id") % 7 == 0, "HTTP 500").alias("error"))
    return keywords.check_batch(k, answers, F.to_date(F.lit("2024-01-10")), balance=0.0501)


_CHECKS = "e AS (SELECT user_id, count(*) AS n, CASE WHEN user_id % 7 = 0 THEN 0 ELSE 0.005 END AS c FROM events GROUP BY 1), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id % 3 ORDER BY user_id) AS spent FROM e), w AS (SELECT * FROM s WHERE spent <= 0.0501)"


@query("serp_batch_counters", f"WITH {_CHECKS} SELECT count_if(user_id % 7 <> 0) AS checked, count_if(user_id % 7 <> 0 AND n % 2 = 0) AS found, count_if(user_id % 7 = 0) AS failed, round(CAST(sum(c) AS DOUBLE), 6) AS cost_usd, count(*) < (SELECT count(*) FROM e) AS out_of_balance FROM w")
def _(spark, d):
    return _checked(spark, d)["counters"]


@query("serp_batch_keywords", f"WITH {_CHECKS} SELECT e.user_id AS keyword_id, CASE WHEN h THEN CASE WHEN n % 2 = 0 THEN n % 10 + 1 END ELSE 9 END AS serp_position, CASE WHEN h THEN 9 END AS serp_previous_position, CASE WHEN h AND n % 2 = 0 THEN least(4, n % 10 + 1) ELSE 4 END AS serp_best_position FROM (SELECT *, user_id % 7 <> 0 AND user_id IN (SELECT user_id FROM w) AS h FROM e) e")
def _(spark, d):
    return _checked(spark, d)["keywords"].select("keyword_id", "serp_position", "serp_previous_position", "serp_best_position")


@query("keyword_manual_insert", "SELECT count(DISTINCT lower(p_name)) FILTER (WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 5 = 0)) AS created, count(*) - created AS skipped FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    wanted = p.select(F.lit("P").alias("project_id"), F.upper("p_name").alias("keyword"), F.lit("ES").alias("country"), F.lit("móvil").alias("device"))
    known = p.where(F.col("p_partkey") % 5 == 0).select(F.lit("P").alias("project_id"), F.lower("p_name").alias("normalized"), F.lit("esp").alias("country"), F.lit("MOBILE").alias("device")).distinct()
    return keywords.insert_manual(wanted, known)[1]


@query("import_counters", "SELECT count_if(k % 3 <> 0) AS created, (SELECT count(*) FROM lineitem) - count_if(k % 3 <> 0) AS updated, 0 AS skipped, count(*) AS total FROM (SELECT DISTINCT l_partkey AS k FROM lineitem)")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    return keywords.import_counters(li, li.where("k % 3 = 0"), ["k"])


@query("locations", "SELECT c_name || CASE WHEN c_custkey % 2 = 0 THEN ', ES' ELSE '' END AS name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY contains(name, ','), name LIMIT 300")
def _(spark, d):
    return keywords.locations(table(spark, d, "customer").select(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ", ES").otherwise("")).alias("name")))


def _import_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A third of the part's words as known keywords, and a history of one day of them."""
    p = table(spark, d, "part").where("p_partkey % 3 = 0")
    null = lambda t: F.lit(None).cast(t)
    known = p.select(
        F.lit("P").alias("project_id"), F.concat("p_name", F.lit(" "), "p_partkey").alias("normalized"), F.lit("esp").alias("country"), F.lit("ALL").alias("device"), F.upper("p_name").alias("keyword"), F.lit("MANUAL").alias("source"), (F.col("p_partkey") % 2 == 0).alias("tracked"),
        F.col("p_brand").alias("tags"), null("string").alias("target_url"), (F.col("p_size") * 1.0).alias("last_position"), null("double").alias("previous_position"), F.when(F.col("p_partkey") % 2 == 0, F.lit(12.0)).alias("best_position"),
        *(null(t).alias(c) for c, t in (("last_clicks", "long"), ("last_impressions", "long"), ("last_ctr", "double"), ("last_url", "string"), ("last_checked_at", "date"))),
    )
    day = F.to_date(F.lit("1998-01-05"))
    return known, known.select(*keyword_import.KEYWORD_KEY, day.alias("date"), F.lit(1.0).alias("position"), F.lit(1).cast("long").alias("clicks"), F.lit(1).cast("long").alias("impressions"), F.lit(0.5).alias("ctr"), F.lit("/old").alias("url"), F.lit("GSC").alias("source"))


def _imported(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    li = table(spark, d, "lineitem").join(p, "l_partkey")
    q, odd = F.col("l_quantity"), F.col("l_linenumber") % 3 == 0
    rows = li.select(
        F.lit("P").alias("project_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("n"), F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "), "l_partkey")).alias("keyword"),
        F.when(~odd, q).alias("position"), F.when(F.col("l_linenumber") % 2 == 0, q / 4).alias("clicks"), F.when(F.col("l_linenumber") % 2 == 0, q * 10).alias("impressions"), F.when(~odd, F.col("l_tax")).alias("ctr"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("/s/"), "l_suppkey")).alias("url"), F.lit("España").alias("country"), F.lit("").alias("device"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), F.when(F.col("l_suppkey") % 3 == 0, "group").alias("tags"),
    )
    return keyword_import.import_rows(rows, *_import_tables(spark, d), F.to_date(F.lit("1998-01-05")))


_IMPORT = """x AS (SELECT p_name || ' ' || l_partkey AS normalized, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, upper(p_name) || '  ' || l_partkey AS keyword, l_suppkey % 7 <> 0 AS valid,
    CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS position, CASE WHEN l_linenumber % 2 = 0 THEN CAST(floor(l_quantity / 4 + 0.5) AS BIGINT) END AS clicks, CASE WHEN l_suppkey % 2 = 0 THEN '/s/' || l_suppkey END AS url,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem JOIN part ON p_partkey = l_partkey),
  v AS (SELECT *, lag(position) OVER (PARTITION BY normalized, position IS NULL ORDER BY n) AS before FROM x WHERE valid),
  o AS (SELECT normalized, arg_max(keyword, n) AS keyword, arg_max(url, n) FILTER (WHERE url IS NOT NULL) AS target_url, arg_max(position, n) FILTER (WHERE position IS NOT NULL) AS last_position, arg_max(coalesce(before, -1), n) FILTER (WHERE position IS NOT NULL) AS before,
    min(position) AS best, arg_max(clicks, n) FILTER (WHERE clicks IS NOT NULL) AS last_clicks FROM v GROUP BY 1),
  k AS (SELECT p_name || ' ' || p_partkey AS normalized, upper(p_name) AS keyword, p_size * 1.0 AS last_position, CASE WHEN p_partkey % 2 = 0 THEN 12.0 END AS best FROM part WHERE p_partkey % 3 = 0)"""


@query("keyword_import_keywords", f"""WITH {_IMPORT} SELECT normalized, coalesce(o.keyword, k.keyword) AS keyword, CASE WHEN k.normalized IS NULL THEN 'CSV' ELSE 'MANUAL' END AS source, o.target_url, coalesce(o.last_position, k.last_position) AS last_position,
    CASE WHEN o.before >= 0 THEN o.before WHEN o.last_position IS NOT NULL THEN k.last_position END AS previous_position, least(o.best, k.best) AS best_position, o.last_clicks FROM o FULL JOIN k USING (normalized)""")
def _(spark, d):
    return _imported(spark, d)["keywords"].select("normalized", "keyword", "source", "target_url", "last_position", "previous_position", "best_position", "last_clicks")


@query("keyword_import_history", f"""WITH {_IMPORT}, h AS (SELECT normalized, date, arg_max(coalesce(position, -1), n) AS position, arg_max(coalesce(clicks, 0), n) AS clicks, arg_max(coalesce(url, ''), n) AS url FROM v WHERE position IS NOT NULL OR clicks IS NOT NULL GROUP BY 1, 2)
  SELECT normalized, CAST(date AS VARCHAR) AS date, nullif(position, -1) AS position, clicks, nullif(url, '') AS url, 'CSV' AS source FROM h
  UNION ALL SELECT normalized, '1998-01-05', 1.0, 1, '/old', 'GSC' FROM k WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.normalized = k.normalized AND h.date = DATE '1998-01-05')""")
def _(spark, d):
    return _imported(spark, d)["history"].select("normalized", F.col("date").cast("string").alias("date"), "position", "clicks", "url", "source")


@query("keyword_import_counters", f"WITH {_IMPORT}, c AS (SELECT count(DISTINCT normalized) FILTER (WHERE valid AND normalized NOT IN (SELECT normalized FROM k)) AS created, count(*) AS total, count_if(NOT valid) AS skipped FROM x) SELECT 'CSV' AS source, total, created, total - created - skipped AS updated, skipped FROM c")
def _(spark, d):
    return _imported(spark, d)["counters"]


def _registered(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    li = table(spark, d, "lineitem").join(p, "l_partkey").groupBy(F.concat(F.upper("p_name"), F.lit(" "), "l_partkey").alias("query"), F.col("l_suppkey").alias("input_order"))
    rows = li.agg(F.avg("l_quantity").alias("position"), F.sum("l_linenumber").cast("double").alias("clicks"), (F.sum("l_linenumber") * 10.0).alias("impressions"), F.lit(0.1).alias("ctr")).withColumn("page", F.concat(F.lit("/s/"), "input_order"))
    return keyword_import.register_queries(rows, _import_tables(spark, d)[0], "P", F.to_date(F.lit("1998-01-05")), min_impressions=30, limit=1500, track=False)


_FOUND = """r AS (SELECT p_name || ' ' || l_partkey AS normalized, l_suppkey AS s, avg(l_quantity) AS position, CAST(sum(l_linenumber) AS BIGINT) AS clicks, sum(l_linenumber) * 10.0 AS impressions FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
  t AS (SELECT normalized, arg_min((position, s, clicks, impressions), (position, s)) AS b FROM r WHERE impressions >= 30 GROUP BY 1 ORDER BY b[4] DESC, 1 LIMIT 1500), k AS (SELECT p_name || ' ' || p_partkey AS normalized, upper(p_name) AS keyword, p_size * 1.0 AS last, p_partkey % 2 = 0 AS tracked FROM part WHERE p_partkey % 3 = 0)"""


@query("discover_keywords", f"""WITH {_FOUND} SELECT normalized, coalesce(k.keyword, upper(normalized)) AS keyword, CASE WHEN k.normalized IS NULL THEN 'GSC' ELSE 'MANUAL' END AS source, coalesce(k.tracked, false) AS tracked, round(coalesce(b[1], k.last), 6) AS last_position,
    CASE WHEN t.normalized IS NOT NULL THEN k.last END AS previous_position, round(least(b[1], CASE WHEN k.tracked THEN 12.0 END), 6) AS best_position, b[3] AS last_clicks, '/s/' || b[2] AS last_url FROM t FULL JOIN k USING (normalized)""")
def _(spark, d):
    found = _registered(spark, d)["keywords"]
    return found.select("normalized", "keyword", "source", "tracked", F.round("last_position", 6).alias("last_position"), "previous_position", F.round("best_position", 6).alias("best_position"), "last_clicks", "last_url")


@query("discover_counters", f"WITH {_FOUND} SELECT 'GSC' AS source, (SELECT count(*) FROM r) AS total, count_if(normalized NOT IN (SELECT normalized FROM k)) AS created, count_if(normalized IN (SELECT normalized FROM k)) AS updated, (SELECT count(*) FROM r) - count(*) AS skipped FROM t")
def _(spark, d):
    return _registered(spark, d)["counters"]


# Site files


@query("robots_allowed", "SELECT page_id, NOT starts_with(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/en/') AS allowed FROM pages WHERE regexp_matches(url, '^[A-Za-z]+://[^/?#]+')")
def _(spark, d):
    from ..sources.robots import allowed_urls

    p = table(spark, d, "pages").where(F.col("url").rlike("^[A-Za-z]+://[^/?#]+")).select("page_id", "url")
    robots = p.select(F.lower(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1)).alias("origin")).distinct().withColumn("text", F.lit("User-agent: *\nDisallow: /en/\nCrawl-delay: 2"))
    return allowed_urls(p, robots, "bot").select("page_id", "allowed")


_PATH = "CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END"
_ROBOTS = """# rules that overlap
User-agent: other
User-agent: Bot
Disallow: /en/
Allow: /en/1   # longer
Disallow: /*.html$
Allow: /en/1*.html
Disallow: /*?page=
Crawl-delay: 0.5

User-agent: *
Disallow: /
"""


@query("robots_longest_rule", rf"""WITH u AS (SELECT page_id, {_PATH} AS p FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS p FROM pages)),
  m AS (SELECT page_id, r.allow, length(rule) AS size FROM u JOIN (VALUES ('/en/', '^/en/', false), ('/en/1', '^/en/1', true), ('/*.html$', '^/.*\.html$', false), ('/en/1*.html', '^/en/1.*\.html', true), ('/*?page=', '^/.*\?page=', false)) r(rule, pattern, allow) ON regexp_matches(p, pattern))
  SELECT page_id, coalesce((SELECT arg_max(allow, (size, allow)) FROM m WHERE m.page_id = u.page_id), true) AS allowed, 0.5 AS crawl_delay FROM u""")
def _(spark, d):
    from ..sources.robots import allowed_urls

    p = table(spark, d, "pages").select("page_id", "url")
    robots = p.select(F.lower(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1)).alias("origin")).distinct().withColumn("text", F.lit(_ROBOTS))
    return allowed_urls(p, robots, "bot/1.0 (+https://bot.example)").select("page_id", "allowed", "crawl_delay")


@query("sitemap_urls", crawl_sql("SELECT DISTINCT normalized_url, url_hash FROM raw"))
def _(spark, d):
    from ..sources.site_files import discover

    p = table(spark, d, "pages")
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    part = F.concat(F.lit("https://s.example/"), (F.col("page_id") % 16).cast("string"), F.lit(".xml"))
    lists = p.groupBy(part.alias("url")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("body"))
    index = spark.createDataFrame([("https://s.example/sitemap.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>https://s.example/{k}.xml</loc></sitemap>" for k in range(16)) + "</sitemapindex>")], "url string, body string")
    return discover(spark, lists.unionByName(index), ["https://s.example/sitemap.xml"]).select("normalized_url", "url_hash")


# Tables in buckets, paged answers


def _customers(spark: SparkSession, d: str) -> tuple[bucket_table.BucketTable, DataFrame]:
    """The customers in buckets, and those that change: every fifth, twice."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    made = bucket_table.BucketTable.create(c, f"{shared_dir(spark)}/sitelens/customers-{uuid.uuid4().hex}", ["c_custkey"], buckets=16)
    fresh = c.where(F.col("c_custkey") % 5 == 0).select("c_custkey", "c_name", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return made, fresh.select("c_custkey", F.concat("c_name", F.lit(" "), F.col("n").cast("string")).alias("c_name"), F.col("n").cast("double").alias("c_acctbal"))


@query("bucket_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' 2' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 2.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, d):
    made, fresh = _customers(spark, d)
    made.upsert(fresh, F.col("c_acctbal"))
    return made.read()


@query("bucket_delete", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0")
def _(spark, d):
    made, fresh = _customers(spark, d)
    made.delete(fresh)
    made.vacuum()
    return made.read()


@query("search_pages", """WITH e AS (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS m FROM events)
  SELECT date, CAST(max(m // 20 + 1) AS BIGINT) AS pages, count(*) AS rows, true AS whole, round(sum(value), 4) AS clicks, max(event_type || ' ' || user_id) AS last_query FROM e GROUP BY 1""")
def _(spark, d):
    """The events of a day as pages of 20 rows, recorded as JSON lines and read back; a day ends with a page that isn't full."""
    by_day = W.Window.partitionBy("date").orderBy("event_id")
    rows = table(spark, d, "events").withColumn("date", F.to_date("ts")).withColumn("n", F.row_number().over(by_day) - 1)
    one = F.struct(F.array(F.concat_ws(" ", "event_type", "user_id"), F.col("event_id").cast("string")).alias("keys"), F.col("value").alias("clicks"), F.lit(1.0).alias("impressions"), F.lit(0.0).alias("ctr"), F.lit(1.0).alias("position"))
    full = rows.groupBy("date", (F.floor(F.col("n") / 20) * 20).alias("start_row")).agg(F.sort_array(F.collect_list(F.struct("n", one.alias("r")))).alias("x"))  # 20 rows each
    ends = rows.groupBy("date").agg(F.count("*").alias("m")).where("m % 20 = 0").select("date", F.col("m").alias("start_row"), F.lit("{}").alias("body"))
    recorded = full.select("date", "start_row", F.to_json(F.struct(F.transform("x", lambda r: r["r"]).alias("rows"))).alias("body")).unionByName(ends)
    path = f"{shared_dir(spark)}/sitelens/recorded-{uuid.uuid4().hex}"
    recorded.select(F.lit("s").alias("site"), "date", "start_row", F.lit("2024-01-01T00:00:00Z").alias("fetched_at"), "body").write.json(path)
    pages = search_api.read_pages(spark, path)
    found = search_api.page_rows_of(pages, ["query", "event"]).groupBy("date").agg(F.round(F.sum("clicks"), 4).alias("clicks"), F.max("query").alias("last_query"))
    return search_api.day_counts(pages, page_rows=20).join(found, "date").select("date", "pages", "rows", "whole", "clicks", "last_query")


# Lookups


def _index(spark: SparkSession, d: str) -> text_index.TextIndex:
    return text_index.TextIndex.build(crawl_pages(spark, d).select("id", "normalized_url", "title"), f"{shared_dir(spark)}/sitelens/index-{uuid.uuid4().hex}", ["normalized_url", "title"])


@query("indexed_search", crawl_sql("SELECT id, lower(normalized_url) AS normalized_url, lower(title) AS title FROM page WHERE contains(lower(normalized_url), 'blog') OR contains(lower(title), 'blog') OR contains(lower(normalized_url), 'example.org/')"))
def _(spark, d):
    index = _index(spark, d)
    return index.search("Blog").unionByName(index.search("example.org/")).distinct()


@query("find_page", crawl_sql("SELECT id, lower(normalized_url) AS normalized_url FROM page WHERE contains(lower(normalized_url), 'example.net/') ORDER BY lower(normalized_url) = 'example.net/' DESC, id LIMIT 1"))
def _(spark, d):
    return text_index.find_page(_index(spark, d), "example.net/").select("id", "normalized_url")


@query("page_lookup", crawl_sql("SELECT crawl_id, id, normalized_url FROM (SELECT crawl_id, id, normalized_url, url_hash FROM page UNION ALL SELECT 'B', id, normalized_url, url_hash FROM page WHERE id % 2 = 0) WHERE crawl_id = 'B' AND url_hash = (SELECT url_hash FROM page WHERE id % 2 = 0 ORDER BY id LIMIT 1)"))
def _(spark, d):
    pages = crawl_pages(spark, d).select("crawl_id", "id", "url", "normalized_url", "url_hash")
    path = f"{shared_dir(spark)}/sitelens/crawls-{uuid.uuid4().hex}"
    crawl_store.write_crawl(pages.unionByName(pages.where("id % 2 = 0").withColumn("crawl_id", F.lit("B"))), path)
    first = pages.where("id % 2 = 0").orderBy("id").select("url").first()
    return crawl_store.lookup(spark, path, "B", first["url"] if first else "").select("crawl_id", "id", "normalized_url")


@query("audit_context", crawl_sql("""SELECT part, id FROM (
  SELECT * FROM (SELECT 'top_pages' AS part, id FROM pm WHERE indexable ORDER BY internal_page_rank DESC, id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'low_inlinks', id FROM pm WHERE indexable AND internal_inlinks <= 1 AND depth > 0 ORDER BY internal_inlinks, id LIMIT 25)
  UNION ALL SELECT * FROM (SELECT 'deep', id FROM pm WHERE coalesce(resource_type, 'HTML_PAGE') = 'HTML_PAGE' AND depth >= 5 ORDER BY depth DESC, id LIMIT 25) UNION ALL SELECT * FROM (SELECT 'redirects', id FROM pm WHERE status_code BETWEEN 300 AND 399 ORDER BY internal_inlinks DESC, id LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'canonicalized', id FROM pm WHERE indexability_reason = 'CANONICALIZED' ORDER BY id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'orphans', id FROM pm WHERE potential_orphan ORDER BY id LIMIT 25)
  UNION ALL SELECT * FROM (SELECT 'broken', source_page_id FROM link l JOIN page t ON t.id = l.target_page_id JOIN page s ON s.id = l.source_page_id WHERE link_type = 'INTERNAL' AND t.status_code >= 400 ORDER BY source_page_id, l.target_page_id LIMIT 25))""", True))
def _(spark, d):
    from .analysis import audit_context

    pages, edges = _crawl(spark, d)
    found = audit_context(pages, edges, rules.page_findings(pages))
    ids = {"broken": "source_page_id"}
    parts = [found[k].select(F.lit(k).alias("part"), F.col(ids.get(k, "id")).alias("id")) for k in ("top_pages", "low_inlinks", "deep", "redirects", "canonicalized", "orphans", "broken")]
    return reduce(DataFrame.unionByName, parts)
