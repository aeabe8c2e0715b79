"""Exports and table changes: CSV, Markdown reports, append, insert-if-absent, upsert, replacement by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seo import alt_state
from .links import image_statuses, link_export

PAGE_COLUMNS = [
    "normalized_url", "status_code", "resource_type", "mime_type", "title", "title_length", "meta_description", "meta_description_length", "h1", "h1_count", "h2_count", "canonical", "meta_robots",
    "word_count", "language", "indexable", "indexability_reason", "depth", "internal_inlinks", "unique_inlinks", "internal_outlinks", "external_outlinks", "internal_page_rank", "in_sitemap", "potential_orphan", "directory",
]


def as_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All columns as text: null becomes empty, booleans true and false."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (columns or df.columns)))


def pages_csv(pages: DataFrame) -> DataFrame:
    return as_text(pages, [c for c in PAGE_COLUMNS if c in pages.columns])


def images_csv(images: DataFrame, pages: DataFrame) -> DataFrame:
    rows = image_statuses(images, pages).join(pages.select(F.col("id").alias("page_id"), F.col("normalized_url").alias("page_url")), "page_id")
    state = alt_state(F.col("has_alt"), F.col("alt"))
    return as_text(rows.select("page_url", "src", state.alias("alt_state"), "alt", "width", "height", "loading", "image_status", "srcset"))


def links_csv(links: DataFrame, pages: DataFrame, link_type: str) -> DataFrame:
    return as_text(link_export(links, pages, link_type))


def issues_csv(findings: DataFrame) -> DataFrame:
    return as_text(findings.select("code", "severity", "title", "url", "details"))


def as_json(df: DataFrame) -> DataFrame:
    """value: each row as JSON, whole numbers of 64 bits as texts, as readers with floating numbers want them; nulls are written."""

    def safe(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.LongType):
            return c.cast("string")
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: safe(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(safe(c[f.name], f.dataType).alias(f.name) for f in kind)))
        return c

    cells = (safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema)
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


EXPORTS = {"pages": pages_csv, "images": images_csv, "links": links_csv, "issues": issues_csv}


def write_csv(df: DataFrame, path: str, *, bom: bool = True) -> None:
    """One CSV file for each partition, with header; with bom the header starts with a byte-order mark, as spreadsheets want it."""
    first = df.columns[0]
    rows = df.withColumnRenamed(first, "﻿" + first) if bom else df
    rows.write.mode("overwrite").csv(path, header=True, encoding="UTF-8", quote='"', escape='"', emptyValue="")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def absent(incoming: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming, one for each key (the smallest), whose key target doesn't hold: what insert-and-skip-duplicates adds."""
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__m")).select(*keys, "__m.*") if rest else incoming.distinct()
    return one.select(*incoming.columns).join(target.select(*keys), keys, "left_anti")


def upserted(target: DataFrame, incoming: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """target with incoming's rows in place of those with their key; of several, the newest (of equally new ones the largest)."""
    rest = F.struct(*(c for c in incoming.columns if c not in keys)) if len(incoming.columns) > len(keys) else F.lit(0)
    fresh = incoming.groupBy(*keys).agg(F.max_by(F.struct(*incoming.columns), F.struct(newest.alias("newest"), rest.alias("rest"))).alias("__m")).select("__m.*")
    return target.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def with_defaults_for_missing(keys: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """rows, and a row of nulls for each key without one."""
    return rows.unionByName(keys.select(*on).distinct().join(rows, on, "left_anti"), allowMissingColumns=True)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite the partitions that df holds rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def export_audit(df: DataFrame, name: str) -> DataFrame:
    """Rows and bytes of an export."""
    size = F.lit(0)
    for c in df.columns:
        size = size + F.coalesce(F.octet_length(F.col(c)), F.lit(0)) + 1
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).withColumn("file", F.lit(name))


def markdown_rows(heads: list[str], rows: list) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def markdown_table(df: DataFrame, most: int = 30) -> str:
    """The first rows of a (sorted, aggregated) table as Markdown."""
    return markdown_rows(df.columns, df.limit(most).collect())


def markdown(title: str, blocks: list[tuple[str, str]]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {head}\n\n{body}" for head, body in blocks)]) + "\n"


def render_markdown(title: str, blocks: list[tuple[str, DataFrame | str]]) -> str:
    """A report of headed blocks: texts as they are, tables as Markdown."""
    return markdown(title, [(head, body if isinstance(body, str) else markdown_table(body)) for head, body in blocks])


RENDERERS = {"md": render_markdown}
