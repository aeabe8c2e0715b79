"""The document of a crawl: headed sections of formatted rows, cut where the document cuts them.

document_rows() is a table, so that a document can be written, compared or rendered elsewhere; to_markdown() collects it, as its
length follows from the cuts and from how many statuses, depths, reasons and resource types there are, not from the crawl's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.seo import percent as share_of
from ..functions.text import format_percent
from ..operators import sinks

# Headings with the columns' heads, in the order of the document.
SECTIONS = [
    ("Datos", ["Dato", "Valor"]), ("Resumen del rastreo", ["Métrica", "Valor"]), ("Recursos descubiertos", ["Métrica", "Valor"]), ("Imágenes dentro de páginas HTML", ["Métrica", "Valor"]),
    ("Códigos de estado", ["Valor", "Páginas"]), ("Profundidad de clic", ["Valor", "Páginas"]), ("Indexabilidad", ["Valor", "Páginas"]), ("Incidencias detectadas", ["Severidad", "Incidencia", "Código", "Páginas"]),
    ("Directorios principales", ["Directorio", "Páginas", "Indexables"]), ("GEO Readiness", ["Categoría", "Puntuación", "Detalle"]), ("Arquitectura del sitio", ["Comunidades"]),
    ("Clusters", ["Cluster", "Páginas", "URL representativa", "Prof. media", "Entradas externas"]), ("Cuellos de botella (betweenness)", ["URL", "Valor"]), ("Hubs", ["URL", "Valor"]), ("Autoridades", ["URL", "Valor"]),
]
# The document's cuts.
MOST = {"Incidencias detectadas": 30, "Directorios principales": 25, "Clusters": 15, "Cuellos de botella (betweenness)": 10, "Hubs": 10, "Autoridades": 10}
LEGACY = "Este rastreo es anterior a la separación entre páginas y recursos, así que sus cifras cuentan imágenes, CSS y JS como si fueran páginas. Relanza el rastreo para obtener el inventario de recursos y la auditoría de imágenes."
ROWS = "section int, heading string, place int, cells array<string>"


def number(n: Column) -> Column:
    """A whole number as Spanish writes it: thousands apart from five digits on."""
    whole = F.round(n).cast("long")
    return F.when(F.abs(whole) < 10000, whole.cast("string")).otherwise(F.translate(F.format_number(whole, 0), ",", "."))


def _section(heading: str, rows: DataFrame, cells: list[Column], order: list[Column]) -> DataFrame:
    """The first rows in order; a null order keeps a row apart from numbers (it sorts first)."""
    at = next(i for i, (h, _) in enumerate(SECTIONS) if h == heading)
    keyed = rows.select(F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), F.array(*cells).alias("cells")).alias("r"))
    kept = keyed.orderBy("r").limit(MOST[heading]) if heading in MOST else keyed
    placed = kept.agg(F.array_sort(F.collect_list("r")).alias("rs")).select(F.posexplode("rs").alias("place", "r"))  # as many as the document shows
    return placed.select(F.lit(at).alias("section"), F.lit(heading).alias("heading"), "place", F.col("r.cells").alias("cells"))


def _list(heading: str, row: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    """A section of named values of one row; a null value has no line."""
    each = row.select(F.posexplode(F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs))).alias("n", "x")).where("x.v is not null")
    return _section(heading, each, [F.col("x.k"), F.col("x.v")], [F.col("n")])


def _geo(geo: DataFrame, readiness: DataFrame) -> DataFrame:
    """Points and explanation of each category."""
    n = F.col("total_indexable")
    of = lambda c: F.concat(share_of(F.col(c), n).cast("string"), F.lit("%"))
    pages = lambda c, some, none: F.when(F.col(c) > 0, F.format_string(some, F.col(c))).otherwise(none)
    # Names, most points and texts of the categories.
    rows = [
        ("entity_clarity", "Claridad de entidad", 15, pages("with_organization", "Organization/LocalBusiness schema presente en %d página(s)", "No se detectó schema Organization ni LocalBusiness")),
        ("structured_data", "Datos estructurados", 20, F.concat(of("with_structured_data"), F.lit(" de las páginas indexables tienen JSON-LD"))),
        ("content_structure", "Estructura del contenido", 15, F.concat(of("with_good_headings"), F.lit(" con jerarquía de headings correcta"))),
        ("machine_readability", "Legibilidad para máquinas", 15, F.concat(of("with_server_content"), F.lit(" con contenido servido en HTML (>=150 palabras)"))),
        ("author_transparency", "Transparencia de autoría", 10, F.concat(of("with_author"), F.lit(" de las páginas identifican un autor"))),
        ("source_transparency", "Transparencia de fuentes", 10, F.concat_ws(" · ", F.when(F.col("has_about_page"), "About detectada").otherwise("Sin página About"), F.when(F.col("has_contact_page"), "Contact detectada").otherwise("Sin página Contact"))),
        ("answerability", "Capacidad de respuesta", 10, F.concat(of("with_dates"), F.format_string(" con fechas; %d página(s) con FAQPage", F.col("with_faq")))),
        ("internal_semantic_linking", "Enlazado semántico interno", 5, pages("with_breadcrumbs", "BreadcrumbList en %d página(s)", "Sin BreadcrumbList detectado")),
    ]
    both = geo.join(F.broadcast(readiness))  # one row each
    each = both.select(F.posexplode(F.array(*(F.struct(F.lit(label).alias("label"), F.format_string("%d/%d", F.col(key), F.lit(most)).alias("points"), text.alias("text")) for key, label, most, text in rows))).alias("n", "x"))
    return _section("GEO Readiness", each, [F.col("x.label"), F.col("x.points"), F.col("x.text")], [F.col("n")])


def document_rows(analysis: dict[str, DataFrame], meta: DataFrame | None = None) -> DataFrame:
    """section, heading, place, cells: the document of an analysis (plans.analysis.analyze()); what the analysis lacks has no section.

    meta is one row of project, domain, status, start_url, crawled_urls, discovered_urls, failed_urls and seconds (null while the
    crawl runs). Without images, as in crawls from before they were looked at, a line says so in place of zeros.
    """
    figures = cut(analysis["stats"], "document-stats")
    named = figures.where("section in ('totals', 'links')").groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "section", "key"), "value"))).alias("m"))  # some twenty names
    row = named.join(F.broadcast(meta)) if meta is not None else named  # one row each
    t = lambda key: F.try_element_at("m", F.lit(f"totals.{key}"))
    about = lambda c: F.col(c) if meta is not None else F.lit(None)
    length = F.when(about("seconds").isNotNull(), F.format_string("%dm %ds", F.floor(about("seconds") / 60).cast("long"), (about("seconds") % 60).cast("long"))).otherwise("—") if meta is not None else F.lit(None)
    geo = "geo" in analysis and "geo_readiness" in analysis
    facts = [("Proyecto", about("project")), ("Dominio", about("domain")), ("Estado", about("status")), ("URLs solicitadas", number(about("crawled_urls"))), ("Páginas HTML", number(t("html_pages"))), ("URLs descubiertas", number(about("discovered_urls"))), ("Fallidas", number(about("failed_urls")))]
    facts += [("SEO Health", F.format_string("%.0f/100", t("seo_health")))]
    facts += [("GEO Readiness", F.format_string("%d/100", F.col("geo_score")))] if geo else []
    scored = row.join(F.broadcast(analysis["geo_readiness"].select(F.col("score").alias("geo_score")))) if geo else row
    parts = [_list("Datos", scored, [*facts, ("Duración", length)])]
    links = lambda key: F.try_element_at("m", F.lit(f"links.{key}"))
    parts.append(_list("Resumen del rastreo", row, [
        ("URL de inicio", about("start_url")), ("Páginas HTML analizadas", number(t("html_pages"))), ("URLs solicitadas (con recursos)", number(t("requested_urls"))), ("Indexables", number(t("indexable"))), ("No indexables", number(t("html_pages") - t("indexable"))),
        ("Errores", number(t("errors_html"))), ("Redirecciones", number(t("redirects"))), ("Enlaces internos", number(links("internal"))), ("Enlaces externos", number(links("external"))), ("Profundidad media", F.format_string("%.1f", t("avg_depth"))),
        ("Tiempo de respuesta medio", F.concat(number(t("avg_response_time")), F.lit(" ms"))), ("Palabras por página (media)", number(t("avg_word_count"))),
    ]))
    of = lambda section: figures.where((F.col("section") == section) & (F.col("value") > 0))
    if "images" in analysis:
        parts.append(_resources(row, of("resource_type"), t))
        i = F.col
        parts.append(_list("Imágenes dentro de páginas HTML", analysis["images"], [
            ("Elementos <img> auditados", number(i("elements"))), ("Sin atributo alt", F.concat(number(i("missing_alt")), F.lit(" ("), format_percent(i("missing_alt_ratio")), F.lit(" de los <img> auditados)"))),
            ('Decorativas (alt="")', F.concat(number(i("decorative_alt")), F.lit(" · válido, sólo informativo"))), ("Con alt descriptivo", number(i("described_alt"))), ("Páginas afectadas por imágenes sin alt", number(i("pages_with_missing_alt"))),
        ]))
    else:
        parts.append(_section("Recursos descubiertos", row, [F.lit(LEGACY)], [F.lit(0)]))
    for heading, section in (("Códigos de estado", "status"), ("Profundidad de clic", "depth"), ("Indexabilidad", "reason")):
        parts.append(_section(heading, of(section), [F.coalesce("key", F.lit("null")), number(F.col("value"))], [-F.col("value"), F.col("key").try_cast("double"), F.col("key")]))
    issues, places = analysis["top_issues"], analysis["directories"]
    parts.append(_section("Incidencias detectadas", issues, [F.col("severity"), F.col("title"), F.col("code"), number(F.col("count"))], [-F.col("count"), F.col("code")]))
    parts.append(_section("Directorios principales", places, [F.coalesce(F.nullif("directory", F.lit("")), F.lit("/")), number(F.col("pages")), number(F.col("indexable"))], [-F.col("pages"), F.col("directory")]))
    parts += [_geo(analysis["geo"], analysis["geo_readiness"])] if geo else []
    if "clusters" in analysis:
        count = of("cluster").agg(F.count("*").alias("n")).where("n > 0")
        parts.append(_section("Arquitectura del sitio", count, [F.concat(number(F.col("n")), F.lit(" comunidad(es) detectada(s)."))], [F.lit(0)]))
        c = analysis["clusters"].join(analysis["cluster_inbound"], "cluster_id", "left")
        parts.append(_section("Clusters", c, [F.col("cluster_id").cast("string"), number(F.col("pages")), F.col("top_url"), F.format_string("%.1f", "avg_depth"), number(F.coalesce("inbound_links", F.lit(0)))], [-F.col("pages"), F.col("cluster_id")]))
    for heading, key, metric in (("Cuellos de botella (betweenness)", "bottlenecks", "betweenness"), ("Hubs", "hubs", "hub_score"), ("Autoridades", "authorities", "authority_score")):
        if key in analysis:
            parts.append(_section(heading, analysis[key], [F.col("normalized_url"), F.format_string("%.4f", metric)], [-F.col(metric), F.col("id")]))
    return reduce(DataFrame.unionByName, parts)


def _resources(row: DataFrame, types: DataFrame, t) -> DataFrame:
    """Figures of what isn't a page, with a line for each type, most first."""
    line = lambda n, k, v, count: F.struct(F.lit(n).alias("n"), (-count).cast("double").alias("count"), k.alias("k"), v.alias("v"))
    plain = [
        (0, "Recursos (no HTML)", number(t("discovered"))), (2, "Imágenes solicitadas", number(t("images"))), (3, "Imágenes rotas", F.concat(number(t("broken_images")), F.lit(" ("), format_percent(t("broken_image_ratio")), F.lit(" de las imágenes solicitadas)"))),
        (4, "Recursos rotos", number(t("broken_assets"))), (5, "Extensión ≠ Content-Type", number(t("mime_mismatches"))),
    ]
    lines = row.select(F.explode(F.array(*(line(n, F.lit(k), v, F.lit(0)) for n, k, v in plain))).alias("x"))
    others = types.where("key <> 'HTML_PAGE'").select(line(1, F.concat(F.lit("· "), "key"), number(F.col("value")), F.col("value")).alias("x"))
    return _section("Recursos descubiertos", lines.unionByName(others), [F.col("x.k"), F.col("x.v")], [F.col("x.n"), F.col("x.count"), F.col("x.k")])


def to_markdown(title: str, rows: DataFrame) -> str:
    """The document in Markdown: a table for each section, sections of one text as they are."""
    cells: dict[str, list[list[str]]] = {}
    for r in rows.orderBy("section", "place").collect():  # bounded by the document's cuts
        cells.setdefault(r["heading"], []).append(r["cells"])
    heads = dict(SECTIONS)
    return sinks.markdown(title, [(h, c[0][0] if len(c[0]) == 1 else sinks.markdown_rows(heads[h], c)) for h, c in cells.items()])
