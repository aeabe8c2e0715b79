"""Crawl tables laid out for lookups: a folder for each crawl, rows in the order of the URL hash, Bloom filters on it.

A lookup of one page of one crawl reads the crawl's folder only; there, the row groups whose range of hashes can't hold the page
are left out by their statistics, others by their Bloom filters. A change of a crawl replaces its folder and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normalize_url, url_hash

#: Bytes of a row group: what a lookup reads at least.
ROW_GROUP = 4 << 20


def write_crawl(pages: DataFrame, path: str, *, key: str = "url_hash", row_group: int = ROW_GROUP, distinct: int = 1_000_000) -> None:
    """Write the crawls of a table (crawl_id, key), each in the place of what its folder held; a large crawl goes to several files, by ranges of the key."""
    rows = pages.repartitionByRange("crawl_id", key).sortWithinPartitions("crawl_id", key)
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", row_group).option("parquet.page.size", row_group // 16)
    out = out.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", distinct).option(f"parquet.enable.dictionary#{key}", "false")
    out.partitionBy("crawl_id").parquet(path)


def read_crawl(spark: SparkSession, path: str, crawl_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if crawl_id is None else rows.where(F.col("crawl_id") == crawl_id)


def lookup(spark: SparkSession, path: str, crawl_id: str, url: str | Column) -> DataFrame:
    """The page of a crawl with a URL, which is normalised as the crawler does."""
    if isinstance(url, str):
        hashed = spark.range(1).select(url_hash(normalize_url(F.lit(url)))).first()[0]  # a value, so that the scan can be pruned by it
        return read_crawl(spark, path, crawl_id).where(F.col("url_hash") == hashed)
    return read_crawl(spark, path, crawl_id).where(F.col("url_hash") == url_hash(normalize_url(url)))
