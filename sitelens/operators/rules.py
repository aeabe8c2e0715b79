"""Audit rules: findings from one pass over the pages, and findings that look at the whole crawl.

A page rule is a condition and a text for the details, both column expressions; all rules of a page are evaluated in one
projection and exploded. The titles are the product's texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.lineage import cut
from ..functions.resources import is_asset
from ..functions.seo import is_auditable, is_valid_hreflang
from ..functions.text import NEAR_DISTANCE, hamming, similarity_percent
from .links import broken_images, broken_internal_links
from .near_duplicates import nearest_duplicates

FINDING = ["page_id", "url", "code", "severity", "title", "details"]
DUPLICATE_PREFIX = 190
#: Hex digits of the fingerprint by which pages are blocked for near-duplicate search: 12 bits.
BLOCK_DIGITS = 3


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    title: str
    condition: Column
    details: Column | None = None


def page_rules() -> list[Rule]:
    """The 25 page rules in their order."""
    # Codes, severities, titles, texts of the details and limits, as users of the product know them.
    c = F.col
    status = F.coalesce(c("status_code"), F.lit(0))
    a = is_auditable(c("resource_type"), c("content_type"), c("status_code"))
    blank = lambda x: F.coalesce(F.trim(c(x)) == "", F.lit(True))
    length = lambda x: F.coalesce(c(x), F.lit(0))
    said = lambda *parts: F.concat(*(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    reason = c("indexability_reason")
    return [
        Rule("HTTP_5XX", "CRITICAL", "Error 5xx", status >= 500, said("Status ", status)),
        Rule("HTTP_4XX", "HIGH", "Error 4xx interno", status.between(400, 499), said("Status ", status, " con ", c("internal_inlinks"), " enlaces internos entrantes")),
        Rule("FETCH_ERROR", "HIGH", "URL no accesible", (c("error_type") != "") & ~c("error_type").isin("UNSUPPORTED_CONTENT", "BLOCKED_ROBOTS"), c("error_type")),
        Rule("REDIRECT_LOOP", "CRITICAL", "Bucle de redirecciones", c("error_type") == "TOO_MANY_REDIRECTS", c("redirect_url")),
        Rule("REDIRECT", "MEDIUM", "Redirección interna", status.between(300, 399), said("Status ", status, " → ", F.coalesce(c("redirect_url"), F.lit("destino desconocido")))),
        Rule("NOINDEX", "HIGH", "Página con noindex", a & (reason == "NOINDEX"), F.coalesce(c("meta_robots"), F.lit("X-Robots-Tag"))),
        Rule("BLOCKED_ROBOTS", "HIGH", "Bloqueada por robots.txt", reason == "BLOCKED_ROBOTS"),
        Rule("CANONICALIZED", "MEDIUM", "URL canonicalizada a otra", a & (reason == "CANONICALIZED"), said("canonical → ", c("canonical"))),
        Rule("MISSING_CANONICAL", "LOW", "Canonical ausente", a & F.coalesce(c("canonical") == "", F.lit(True))),
        Rule("POTENTIAL_ORPHAN", "HIGH", "Página huérfana potencial", a & c("potential_orphan"), F.lit("En sitemap, sin inlinks internos")),
        Rule("MISSING_TITLE", "MEDIUM", "Title ausente", a & blank("page_title")),
        Rule("TITLE_TOO_LONG", "LOW", "Title demasiado largo", a & (length("title_length") > 60), said(length("title_length"), " caracteres")),
        Rule("TITLE_TOO_SHORT", "LOW", "Title demasiado corto", a & length("title_length").between(1, 19), said(length("title_length"), " caracteres")),
        Rule("MISSING_DESCRIPTION", "MEDIUM", "Meta description ausente", a & blank("meta_description")),
        Rule("DESCRIPTION_TOO_LONG", "LOW", "Meta description demasiado larga", a & (length("meta_description_length") > 160), said(length("meta_description_length"), " caracteres")),
        Rule("DESCRIPTION_TOO_SHORT", "LOW", "Meta description demasiado corta", a & length("meta_description_length").between(1, 69), said(length("meta_description_length"), " caracteres")),
        Rule("MISSING_H1", "MEDIUM", "H1 ausente", a & (c("h1_count") <= 0)),
        Rule("MULTIPLE_H1", "MEDIUM", "Múltiples H1", a & (c("h1_count") > 1), said(c("h1_count"), " etiquetas H1")),
        Rule("DEEP_PAGE", "MEDIUM", "Profundidad mayor a 4", a & c("indexable") & (c("depth") > 4), said("Profundidad ", c("depth"))),
        Rule("LOW_INLINKS", "MEDIUM", "Pocos enlaces internos entrantes", a & c("indexable") & (c("depth") != 0) & (c("internal_inlinks") < 2), said(c("internal_inlinks"), " inlinks")),
        Rule("THIN_CONTENT", "LOW", "Contenido escaso", a & c("indexable") & (c("word_count") < 200), said(c("word_count"), " palabras")),
        Rule("IMAGES_MISSING_ALT", "LOW", "Imágenes sin atributo alt", a & (c("images_missing_alt") > 0), said(c("images_missing_alt"), " de ", c("images_count"), " imágenes sin atributo alt")),
        Rule("IMAGES_DECORATIVE_ALT", "INFO", "Imágenes decorativas (alt vacío)", a & (c("images_decorative") > 0), said(c("images_decorative"), " de ", c("images_count"), ' imágenes con alt=""')),
        Rule("MIME_MISMATCH", "LOW", "Extensión y Content-Type no coinciden", c("mime_mismatch") & (c("status_code") < 300), said("Content-Type: ", F.coalesce(c("mime_type"), F.lit("desconocido")))),
        Rule(
            "BROKEN_ASSET", "MEDIUM", "Recurso roto",
            is_asset(c("media_type")) & ~F.coalesce(c("error_type") == "BLOCKED_ROBOTS", F.lit(False)) & (c("status_code").isNull() | (c("status_code") >= 400)),
            said(c("media_type"), " · ", F.when(c("status_code").isNotNull(), said("Status ", c("status_code"))).otherwise(F.coalesce(c("error_type"), F.lit("sin respuesta")))),
        ),
    ]


def page_findings(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """A row for each rule that holds of each page."""
    one = lambda r: F.when(F.coalesce(r.condition, F.lit(False)), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title"), (r.details if r.details is not None else F.lit(None)).cast("string").alias("details")))
    found = F.filter(F.array(*map(one, page_rules() if rules is None else rules)), lambda x: x.isNotNull())
    source = pages.withColumnRenamed("title", "page_title") if "title" in pages.columns else pages
    return source.select(F.col("id").alias("page_id"), F.substring("normalized_url", 1, 2000).alias("url"), F.explode(found).alias("f")).select("page_id", "url", "f.*")


def _finding(df: DataFrame, page_id: str, url: str, code: str, severity: str, title: str, details: Column) -> DataFrame:
    return df.select(F.col(page_id).alias("page_id"), F.substring(url, 1, 2000).alias("url"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), details.alias("details"))


def crawl_key(pages: DataFrame) -> list[str]:
    """Pages of several crawls, told apart by crawl_id, are only compared within their own."""
    return ["crawl_id"] if "crawl_id" in pages.columns else []


def duplicates(pages: DataFrame, column: str, *, collation: str | None = None) -> DataFrame:
    """Indexable HTML pages of a crawl that share a value (its first 190 characters): id, URL, value, number of pages.

    collation compares as a database with that collation does, e.g. UNICODE_CI_AI_RTRIM; by default bytes are compared.
    """
    crawl = crawl_key(pages)
    value = F.substring(column, 1, DUPLICATE_PREFIX)
    own = pages.where(F.col("indexable") & (F.col("resource_type") == "HTML_PAGE") & (F.col(column) != "")).select(*crawl, "id", "normalized_url", value.alias("value"))
    key = F.collate("value", collation) if collation else F.col("value")
    many = own.groupBy(*crawl, key.alias("__k")).agg(F.count("*").alias("cnt")).where("cnt > 1")
    return own.withColumn("__k", key).join(many, [*crawl, "__k"]).drop("__k", *crawl)


def duplicate_findings(pages: DataFrame) -> DataFrame:
    kinds = [("title", "DUPLICATE_TITLE", "Title duplicado"), ("meta_description", "DUPLICATE_DESCRIPTION", "Meta description duplicada"), ("content_hash", "DUPLICATE_CONTENT", "Contenido duplicado")]
    said = F.concat(F.lit("Compartido por "), F.col("cnt").cast("string"), F.lit(' páginas: "'), F.col("value"), F.lit('"'))
    return reduce(DataFrame.unionByName, [_finding(duplicates(pages, c), "id", "normalized_url", code, "MEDIUM", title, said) for c, code, title in kinds])


def broken_link_findings(links: DataFrame, pages: DataFrame) -> DataFrame:
    anchor = F.when(F.col("anchor") != "", F.concat(F.lit(' · anchor: "'), F.col("anchor"), F.lit('"'))).otherwise("")
    said = F.concat(F.lit("→ "), F.col("target_url"), F.lit(" ("), F.col("status_code").cast("string"), F.lit(")"), anchor)
    return _finding(broken_internal_links(links, pages), "source_page_id", "source_url", "BROKEN_INTERNAL_LINK", "HIGH", "Enlace interno roto", said)


def broken_image_findings(images: DataFrame, pages: DataFrame) -> DataFrame:
    said = F.concat(F.lit("→ "), F.col("image_url"), F.lit(" ("), F.coalesce(F.col("status_code").cast("string"), F.lit("sin respuesta")), F.lit(") · "), F.col("appearances").cast("string"), F.lit(" apariciones"))
    return _finding(broken_images(images, pages), "page_id", "source_url", "BROKEN_IMAGE", "HIGH", "Imagen rota en la página", said)


def _comparable(pages: DataFrame, digits: int, block_cap: int | None) -> DataFrame:
    own = pages.where(F.col("indexable") & F.col("simhash").isNotNull() & (F.col("word_count") >= 50))
    own = own.select(*crawl_key(pages), "id", "normalized_url", "simhash", "content_hash", F.substring("simhash", 1, digits).alias("block"))
    if block_cap is not None:
        own = own.withColumn("__n", F.row_number().over(W.Window.partitionBy(*crawl_key(pages), "block").orderBy("id"))).where(F.col("__n") <= block_cap).drop("__n")
    return own


def _close(own: DataFrame, digits: int) -> DataFrame:
    """simhash_a <= simhash_b, distance of fingerprints in one block: of NEAR_DISTANCE + 1 parts of the rest one at least is equal."""
    keys = [*crawl_key(own), "block"]
    prints = own.groupBy(*keys, "simhash").agg(F.count("*").alias("pages"), F.min("id").alias("first_id"), F.count_distinct("content_hash").alias("contents"), F.count_if(F.col("content_hash").isNull()).alias("unknown"))
    rest, n = 16 - digits, NEAR_DISTANCE + 1
    ends = [digits + rest * k // n for k in range(n + 1)]
    cut_up = F.array(*(F.substring("simhash", a + 1, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)))
    posted = cut(prints, "prints").withColumn("parts", cut_up).select("*", F.posexplode("parts").alias("k", "part"))
    sides = [posted.select(*keys, "k", "part", *(F.col(c).alias(f"{c}_{x}") for c in ("simhash", "pages", "first_id", "contents", "unknown", "parts"))) for x in "ab"]
    both = sides[0].join(sides[1], [*keys, "k", "part"]).where("simhash_a <= simhash_b")
    first = F.array_position(F.zip_with("parts_a", "parts_b", lambda x, y: x == y), True) == F.col("k") + 1  # a pair counts where it meets first
    found = both.where(first).withColumn("distance", hamming(F.col("simhash_a"), F.col("simhash_b")).cast("int")).where(F.col("distance") <= NEAR_DISTANCE)
    several = F.col("contents_a") + F.col("unknown_a") > 1  # equal fingerprints of other contents
    return found.where((F.col("simhash_a") < F.col("simhash_b")) | several).drop("k", "part", "parts_a", "parts_b", "contents_a", "contents_b", "unknown_a", "unknown_b", "block")


def near_duplicate_prints(pages: DataFrame, *, digits: int = BLOCK_DIGITS, block_cap: int | None = None) -> DataFrame:
    """simhash_a, simhash_b, distance, similarity, and of each the number of pages and the first id: near-duplicates by fingerprint.

    Pages of one fingerprint are its members; so a large group of near copies gives a row for each two fingerprints, not for
    each two pages. A fingerprint with itself is a row if its pages have several contents.
    """
    return _close(_comparable(pages, digits, block_cap), digits).withColumn("similarity", similarity_percent(F.col("distance")))


def near_duplicate_pairs(pages: DataFrame, *, digits: int = BLOCK_DIGITS, block_cap: int | None = None) -> DataFrame:
    """Pairs of pages in one block whose fingerprints differ in at most six bits and whose contents aren't equal.

    block_cap compares the first so many pages of a block only, as the product does; by default blocks are whole.
    """
    own, crawl = _comparable(pages, digits, block_cap), crawl_key(pages)
    close = _close(own, digits).select(*crawl, "simhash_a", "simhash_b", "distance")
    one = own.select(*crawl, F.col("simhash").alias("simhash_a"), F.col("id").alias("id_x"), F.col("normalized_url").alias("url_x"), F.col("content_hash").alias("content_x"))
    two = own.select(*crawl, F.col("simhash").alias("simhash_b"), F.col("id").alias("id_y"), F.col("normalized_url").alias("url_y"), F.col("content_hash").alias("content_y"))
    pairs = close.join(one, [*crawl, "simhash_a"]).join(two, [*crawl, "simhash_b"])
    pairs = pairs.where(((F.col("simhash_a") != F.col("simhash_b")) | (F.col("id_x") < F.col("id_y"))) & ~F.coalesce(F.col("content_x") == F.col("content_y"), F.lit(False)))
    low = F.col("id_x") < F.col("id_y")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    return pairs.select(pick("id_x", "id_y").alias("id_a"), pick("url_x", "url_y").alias("url_a"), pick("id_y", "id_x").alias("id_b"), pick("url_y", "url_x").alias("url_b"), "distance", similarity_percent(F.col("distance")).alias("similarity"))


def near_duplicate_findings(pages: DataFrame) -> DataFrame:
    """A finding for each page that has a near-duplicate, with the nearest one; all pairs are found, whatever block they would be in."""
    said = F.concat(F.col("similarity").cast("string"), F.lit("% similar a "), F.col("other_url"))
    return _finding(nearest_duplicates(pages), "id", "url", "NEAR_DUPLICATE_CONTENT", "MEDIUM", "Contenido casi duplicado", said)


def schema_findings(schemas: DataFrame, pages: DataFrame) -> DataFrame:
    """Invalid JSON-LD, and types without required or recommended properties. schemas: page_id, schema_type, raw_json, valid_json."""
    from ..sources.html import missing_properties_udf

    joined = schemas.join(pages.select(F.col("id").alias("page_id"), F.col("normalized_url").alias("page_url")), "page_id")
    invalid = _finding(joined.where(~F.col("valid_json")), "page_id", "page_url", "SCHEMA_INVALID_JSON", "MEDIUM", "JSON-LD inválido", F.lit(None).cast("string"))
    lacking = joined.where("valid_json").withColumn("m", F.explode(missing_properties_udf("schema_type", "raw_json"))).select("page_id", "page_url", "schema_type", "m.*")
    required = F.col("kind") == "REQUIRED"
    said = F.concat(F.col("schema_type"), F.lit(": "), F.array_join("missing", ", "))
    title = F.when(required, "Schema sin propiedades obligatorias").otherwise("Schema sin propiedades recomendadas")
    rows = lacking.select("page_id", F.substring("page_url", 1, 2000).alias("url"), F.concat(F.lit("SCHEMA_MISSING_"), "kind").alias("code"), F.when(required, "MEDIUM").otherwise("LOW").alias("severity"), title.alias("title"), said.alias("details"))
    return invalid.unionByName(rows)


def hreflang_findings(hreflangs: DataFrame, pages: DataFrame) -> DataFrame:
    """hreflangs: page_id, href (normalised, null if it can't be), language. Details list the first five, by place."""
    urls = pages.select(F.col("id").alias("page_id"), F.col("normalized_url").alias("page_url"), "status_code")
    e = hreflangs.join(urls.select("page_id", "page_url"), "page_id")
    invalid = e.where(~is_valid_hreflang(F.col("language"))).groupBy("page_id", "page_url").agg(F.array_join(F.array_sort(F.collect_list("language")), ", ").alias("details")).withColumn("code", F.lit("HREFLANG_INVALID_CODE"))
    no_self = e.groupBy("page_id", "page_url").agg(F.bool_or(F.coalesce(F.col("href") == F.col("page_url"), F.lit(False))).alias("self")).where("not self").select("page_id", "page_url", F.lit("El conjunto no incluye una etiqueta que apunte a esta misma URL").alias("details"), F.lit("HREFLANG_MISSING_SELF").alias("code"))
    away = e.where(F.col("href").isNotNull() & (F.col("href") != F.col("page_url"))).select("page_id", "page_url", "href")
    listed = lambda c: F.array_join(F.slice(F.array_sort(F.collect_list(c)), 1, 5), " · ").alias("details")
    status = urls.select(F.col("page_url").alias("href"), "status_code")
    bad = away.join(status, "href").where(F.col("status_code").isNull() | (F.col("status_code") >= 300))
    broken = bad.groupBy("page_id", "page_url").agg(listed(F.concat("href", F.lit(" ("), F.coalesce(F.col("status_code").cast("string"), F.lit("sin respuesta")), F.lit(")")))).withColumn("code", F.lit("HREFLANG_BROKEN_TARGET"))
    declares = e.select(F.col("page_url").alias("href")).distinct()
    back = e.select(F.col("page_url").alias("href"), F.col("href").alias("page_url")).distinct()
    one_way = away.join(declares, "href", "left_semi").join(back, ["href", "page_url"], "left_anti").groupBy("page_id", "page_url").agg(listed("href")).withColumn("code", F.lit("HREFLANG_NOT_RECIPROCAL"))
    every = reduce(DataFrame.unionByName, [invalid, no_self, broken, one_way])
    title = F.create_map(*[F.lit(x) for kv in {"HREFLANG_INVALID_CODE": "Código hreflang inválido", "HREFLANG_MISSING_SELF": "Hreflang sin autorreferencia", "HREFLANG_BROKEN_TARGET": "Hreflang hacia una URL rota", "HREFLANG_NOT_RECIPROCAL": "Hreflang no recíproco"}.items() for x in kv])
    severity = F.when(F.col("code") == "HREFLANG_BROKEN_TARGET", "HIGH").otherwise("MEDIUM")
    return every.select("page_id", F.substring("page_url", 1, 2000).alias("url"), "code", severity.alias("severity"), F.element_at(title, F.col("code")).alias("title"), "details")


def all_findings(pages: DataFrame, links: DataFrame, images: DataFrame | None = None, schemas: DataFrame | None = None, hreflangs: DataFrame | None = None) -> DataFrame:
    """Every finding of a crawl."""
    parts = [page_findings(pages), duplicate_findings(pages), broken_link_findings(links, pages), near_duplicate_findings(pages)]
    parts += [broken_image_findings(images, pages)] if images is not None else []
    parts += [schema_findings(schemas, pages)] if schemas is not None else []
    parts += [hreflang_findings(hreflangs, pages)] if hreflangs is not None else []
    return reduce(DataFrame.unionByName, [p.select(*FINDING) for p in parts])
