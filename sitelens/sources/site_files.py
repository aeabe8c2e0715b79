"""Sitemaps and fetches: URLs listed by (nested) sitemaps, and guarded requests."""

from __future__ import annotations

import gzip
import itertools
import ipaddress
import re
import socket
from collections.abc import Callable
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..functions.netguard import BLOCKED_HOSTS, is_private_address
from ..functions.resources import HTML_MIMES
from ..functions.urls import normalize

MAX_BODY = 5 * 1024 * 1024


def default_candidates(origin: Column) -> Column:
    """Where a site's sitemaps usually are."""
    return F.transform(F.array(*map(F.lit, ["/sitemap.xml", "/sitemap_index.xml"])), lambda p: F.concat(origin, p))


def read_sitemap(body: bytes | str) -> tuple[list[str], list[str]]:
    """Page URLs and nested sitemaps of one document; both empty if it is none."""
    raw = body.encode() if isinstance(body, str) else body
    try:
        raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        root = ElementTree.fromstring(raw)
    except (ElementTree.ParseError, OSError):
        return [], []
    name = lambda e: re.sub(r"^\{.*\}", "", e.tag)
    found: dict[str, list[str]] = {"url": [], "sitemap": []}
    for child in root:
        if name(child) in found:
            found[name(child)] += [e.text.strip() for e in child if name(e) == "loc" and e.text and e.text.strip()]
    return found["url"], found["sitemap"]


def discover(spark: SparkSession, documents: DataFrame, seeds: list[str], *, max_levels: int | None = None, max_urls: int | None = None, max_sitemaps: int | None = None) -> DataFrame:
    """url, normalized_url, url_hash, sitemap of all URLs reached from the seed sitemaps; documents has url and body.

    One round for each level of nesting, however many there are: sitemaps of the level are joined to documents and those seen before left out. A URL that
    several sitemaps list is told of the first. max_sitemaps and max_urls are a crawler's own limits: the first by level and name.
    """
    schema = T.StructType([T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("nested", T.ArrayType(T.StringType()))])

    @F.pandas_udf(schema)
    def parse(body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_sitemap(b if b is not None else b"") for b in body], columns=["pages", "nested"])

    @F.pandas_udf(T.StringType())
    def normal(url: pd.Series) -> pd.Series:
        return url.map(normalize)

    level = spark.createDataFrame([(s,) for s in seeds], "url string").distinct()
    seen, found = level, None
    for k in itertools.count() if max_levels is None else range(max_levels):
        if max_sitemaps is not None:
            level = level.orderBy("url").limit(max(0, max_sitemaps - (seen.count() - level.count())))
        read = cut(documents.join(level, "url", "left_semi").select(F.col("url").alias("sitemap"), parse("body").alias("x")), "sitemaps")
        pages = read.select(F.explode("x.pages").alias("url"), "sitemap", F.lit(k).alias("level"))
        found = pages if found is None else found.unionByName(pages)
        level = cut(read.select(F.explode("x.nested").alias("url")).distinct().join(seen, "url", "left_anti"), "nested")
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level), "seen")
    out = found.withColumn("normalized_url", normal("url")).where(F.col("normalized_url").isNotNull())
    first = out.groupBy("normalized_url").agg(F.min(F.struct("level", "sitemap", "url")).alias("x")).select("x.url", "normalized_url", F.sha2("normalized_url", 256).alias("url_hash"), "x.sitemap", "x.level")
    first = first.orderBy("level", "normalized_url").limit(max_urls) if max_urls is not None else first
    return first.drop("level")


def _addresses(host: str) -> list[str]:
    try:
        return sorted({x[4][0] for x in socket.getaddrinfo(host, None)})
    except OSError:
        return []


def hop_verdict(url: str, resolve: Callable[[str], list[str]] = _addresses) -> str | None:
    """Null if one hop may be fetched, else why not; names are resolved, and all their addresses must be public."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower().rstrip(".")
    except ValueError:
        return "INVALID_URL"
    if parts.scheme not in ("http", "https"):
        return "PROTOCOL"
    if not host:
        return "INVALID_URL"
    if host in BLOCKED_HOSTS or host.endswith(".localhost"):
        return "BLOCKED_HOST"
    try:
        found = [str(ipaddress.ip_address(host))]
    except ValueError:
        found = resolve(host)
    if not found:
        return "DNS_ERROR"
    return "PRIVATE_IP" if any(map(is_private_address, found)) else None


def fetch(url: str, get: Callable[[str], dict], *, max_redirects: int = 10, max_bytes: int = MAX_BODY, resolve: Callable[[str], list[str]] = _addresses) -> dict:
    """One URL by a transport get(url) -> status, content_type, body, location: redirects by hand, loops ended, bodies capped.

    Each hop is checked after its name is resolved, before it is asked. A redirected URL keeps the status of its first answer and
    no body; of others the first max_bytes are kept, of HTML or untyped answers only.
    """
    chain: list[str] = []
    first, here, seen = None, url, set()
    gone = lambda why: {"url": url, "final_url": here, "status": None, "content_type": None, "body": None, "redirect_chain": chain, "error_type": why}
    for _ in range(max_redirects + 1):
        if here in seen:
            break
        seen.add(here)
        if why := hop_verdict(here, resolve):
            return gone(why)
        answer = get(here)
        first = first if first is not None else answer.get("status")
        status, location = answer.get("status"), answer.get("location")
        if status is not None and 300 <= status < 400 and location:
            chain.append(here)
            here = normalize(location, here) or location
            continue
        kind = (answer.get("content_type") or "").split(";")[0].strip().lower()
        body = answer.get("body") if not chain and (not kind or kind in HTML_MIMES) else None
        return {"url": url, "final_url": here, "status": first, "content_type": answer.get("content_type"), "body": body[:max_bytes] if body else body, "redirect_chain": chain, "error_type": answer.get("error_type")}
    return gone("TOO_MANY_REDIRECTS")
