"""Keyword files: CSV exports of search consoles and rank trackers, whatever their separator and headers."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seo import half_up
from ..functions.text import is_valid_keyword, normalize_country, normalize_device, normalize_keyword, parse_ctr, parse_date, parse_number

MAX_ROWS = 50_000
# Column headers by field.
ALIASES = {
    "keyword": ["keyword", "keywords", "query", "consulta", "consultas", "palabra clave", "palabras clave", "term", "search term", "búsqueda"],
    "position": ["position", "posicion", "posición", "avg position", "average position", "posición media", "posicion media", "rank", "ranking", "pos"],
    "clicks": ["clicks", "clics", "clicks totales", "total clicks"],
    "impressions": ["impressions", "impresiones", "impressions totales", "total impressions", "impr", "impr."],
    "ctr": ["ctr", "click through rate", "ctr medio", "average ctr"],
    "url": ["url", "page", "página", "pagina", "landing page", "destino", "target url"],
    "country": ["country", "país", "pais", "location", "mercado"],
    "device": ["device", "dispositivo"],
    "date": ["date", "fecha", "day", "día"],
    "tags": ["tags", "etiquetas", "grupo", "group", "categoría", "categoria"],
}
_FIELD_OF = {name: field for field, names in ALIASES.items() for name in names}


def column_map(headers: list[str]) -> dict[str, int]:
    """Place of each field; the first header that names it wins."""
    out: dict[str, int] = {}
    for i, h in enumerate(headers):
        field = _FIELD_OF.get(h.lstrip("﻿").strip().lower())
        if field:
            out.setdefault(field, i)
    return out


def separator_of(line: str) -> str:
    return max(",;\t", key=lambda c: line.count(c))


def read_rows(spark: SparkSession, path: str, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """n, keyword, position, clicks, impressions, ctr, url, country, device, date, tags of a file's rows, valid or not; n sorts as the file does.

    Headers are matched by name; a file without known headers is read as one keyword in the first column of each line.
    Rows may be ragged. max_rows is the importer's own limit: the file's first rows.
    """
    first = spark.read.text(path).limit(1).collect()
    line = (first[0]["value"] if first else "").lstrip("﻿")
    sep = separator_of(line)
    headers = next(csv.reader(io.StringIO(line), delimiter=sep), [])
    places = column_map(headers)
    width = max(len(headers), 1)
    columns = ", ".join(f"c{i} string" for i in range(width))
    raw = spark.read.schema(columns).option("sep", sep).option("mode", "PERMISSIVE").option("multiLine", True).option("header", "keyword" in places).option("enforceSchema", True).csv(path)
    if "keyword" not in places:
        places = {"keyword": 0}
    text = lambda f: F.trim(F.regexp_replace(F.col(f"c{places[f]}"), "﻿", "")) if f in places else F.lit(None).cast("string")
    return raw.withColumn("n", F.monotonically_increasing_id()).orderBy("n").limit(max_rows).select(
        "n", text("keyword").alias("keyword"), parse_number(text("position")).alias("position"), parse_number(text("clicks")).alias("clicks"), parse_number(text("impressions")).alias("impressions"),
        parse_ctr(text("ctr")).alias("ctr"), text("url").alias("url"), text("country").alias("country"), text("device").alias("device"), parse_date(text("date")).alias("date"), text("tags").alias("tags"),
    )


def read_keywords(spark: SparkSession, path: str, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """A file's rows that hold a keyword, with normalized; countries and devices are normalised, clicks and impressions whole numbers."""
    rows = read_rows(spark, path, max_rows=max_rows).withColumns({
        "country": normalize_country(F.col("country")), "device": normalize_device(F.col("device")), "clicks": half_up(F.col("clicks")).cast("long"), "impressions": half_up(F.col("impressions")).cast("long"), "normalized": normalize_keyword(F.col("keyword")),
    })
    return rows.where(is_valid_keyword(F.col("normalized"))).drop("n")
