"""Simhash and similarity, keywords, numbers, dates and small text helpers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE = 4
NEAR_DISTANCE = 6
# Alpha-3 codes of the countries that may be given by alpha-2 code, and names of devices.
COUNTRIES = {"es": "esp", "mx": "mex", "ar": "arg", "co": "col", "cl": "chl", "pe": "per", "us": "usa", "gb": "gbr", "uk": "gbr", "fr": "fra", "de": "deu", "it": "ita", "pt": "prt", "br": "bra"}
DEVICES = {"DESKTOP": ["DESKTOP", "ESCRITORIO"], "MOBILE": ["MOBILE", "MÓVIL", "MOVIL"], "TABLET": ["TABLET", "TABLETA"]}


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, of two characters or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: F.length(w) > 1)


def _shingle_head(words: Column, i: Column) -> Column:
    """The first 64 bits of the MD5 of the i-th shingle (from 1)."""
    digest = F.md5(F.array_join(F.slice(words, i, SHINGLE), " ").cast("binary"))
    return F.shiftleft(hex_half(digest, True), 32).bitwiseOR(hex_half(digest, False))


def with_simhash(df: DataFrame, key: str, text: str, into: str = "simhash") -> DataFrame:
    """df with 64 bits as 16 hex digits, by majority over the MD5 heads of the text's four-word shingles; null under four words.

    key is unique. Shingles are exploded and summed up by key: bits k and k + 32 of the heads are counted together, in the halves
    of one long, and a text's rows are summed up where they arise.
    """
    words = df.select(F.col(key).alias("key"), tokens(F.col(text)).alias("words")).where(F.size("words") >= SHINGLE)
    each = words.select("key", "words", F.explode(F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1))).alias("i")).select("key", _shingle_head(F.col("words"), F.col("i")).alias("x"))
    votes = each.groupBy("key").agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("x", k).bitwiseAND((1 << 32) | 1)).alias(f"v{k}") for k in range(32)))

    def half(won: Callable[[Column], Column]) -> Column:
        bits = [F.when(2 * won(F.col(f"v{k}")) > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(32)]
        return F.lpad(F.lower(F.hex(reduce(Column.__add__, bits[1:], bits[0].cast("long")))), 8, "0")

    found = votes.select("key", F.concat(half(lambda v: F.shiftrightunsigned(v, 32)), half(lambda v: v.bitwiseAND(0xFFFFFFFF))).alias(into))
    return df.drop(into).join(found.withColumnRenamed("key", key), key, "left")


def hex_half(h: Column, first: bool) -> Column:
    return F.conv(F.substring(h, 1 if first else 9, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two fingerprints of 16 hex digits."""
    return F.bit_count(hex_half(a, True).bitwiseXOR(hex_half(b, True))) + F.bit_count(hex_half(a, False).bitwiseXOR(hex_half(b, False)))


def similarity_percent(distance: Column) -> Column:
    return F.floor((64 - distance) / 64 * 100 + 0.5).cast("int")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t.lower())).strip())


def normalize_keyword(keyword: Column) -> Column:
    """Lower case, NFKC, single spaces; ASCII stays in the JVM."""
    plain = keyword.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.trim(F.regexp_replace(F.lower(keyword), r"\s+", " "))).otherwise(_nfkc(F.when(~plain, keyword)))


def is_valid_keyword(normalized: Column) -> Column:
    return F.coalesce(F.length(normalized).between(1, 255), F.lit(False))


def normalize_country(value: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    codes = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    return F.when(F.length(raw) == 3, raw).otherwise(F.coalesce(F.element_at(codes, raw), F.lit("esp")))


def normalize_device(value: Column) -> Column:
    raw = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    chain = F
    for device, names in DEVICES.items():
        chain = chain.when(raw.isin(names), device)
    return chain.otherwise("ALL")


def parse_ctr(text: Column) -> Column:
    """A share; per cent if it says so or is over 1."""
    n = F.trim(F.replace(F.regexp_replace(text, "%", ""), F.lit(","), F.lit("."))).try_cast("double")
    return F.when((text != "") & ~F.isnan(n), F.when(text.contains("%") | (n > 1), n / 100).otherwise(n))


def parse_number(text: Column) -> Column:
    """Points before three digits part thousands, a comma the decimals."""
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s", ""), r"\.(?=\d{3}\b)", ""), ",", ".").try_cast("double")
    return F.when((text != "") & ~F.isnan(n), n)


def parse_date(text: Column) -> Column:
    """d/m/yyyy, d-m-yyyy or ISO."""
    t = F.trim(text)
    day = F.regexp_extract(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", 1)
    made = F.concat_ws("-", F.regexp_extract(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", 3), F.regexp_extract(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", 2), day)
    return F.when(day != "", F.try_to_date(made, "y-M-d")).otherwise(t.try_cast("timestamp").cast("date"))


def offset_minutes(project_id: Column) -> Column:
    """Minutes by which a project's daily run is put off, from the first two bytes of its hash."""
    return (F.conv(F.substring(F.sha2(project_id, 256), 1, 4), 16, 10).cast("int") % 240).cast("int")


def scheduled_time(project_id: Column, day: Column) -> Column:
    return F.to_timestamp(day) + F.make_dt_interval(F.lit(0), F.lit(4), offset_minutes(project_id))


def normalize_target(target: Column) -> Column:
    """A bare domain: no scheme, www. or path."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(target)), r"^https?://", ""), r"^www\.", "")
    return F.substring_index(bare, "/", 1)


def split_patterns(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n,]+"), lambda x: F.trim(x)), lambda x: x != "")


def top_organic(items: Column, most: int = 10) -> Column:
    """The first organic results as struct(rank, domain, url, title)."""
    organic = F.slice(F.filter(items, lambda x: x["type"] == "organic"), 1, most)
    return F.transform(organic, lambda x: F.struct(F.coalesce(x["rank_group"], x["rank_absolute"]).alias("rank"), x["domain"].alias("domain"), x["url"].alias("url"), x["title"].alias("title")))


def effective_rank(found: Column, rank_group: Column, rank_absolute: Column) -> Column:
    return F.when(found, F.coalesce(rank_group, rank_absolute))


def format_percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNotNull(), F.concat(F.format_number(x * 100, digits), F.lit("%")))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(hours > 0, F.format_string("%dh %dm", hours, minutes)).when(minutes > 0, F.format_string("%dm %ds", minutes, s % 60)).otherwise(F.format_string("%ds", s))


def match_pattern(text: Column, pattern: str) -> Column:
    """A case-insensitive regular expression, or a part of the text if it is no valid one."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lower(text).contains(pattern.lower())
    return text.rlike(f"(?i){pattern}")
