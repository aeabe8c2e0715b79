"""robots.txt by RFC 9309: a file's rules for an agent as a column, and whether URLs are allowed by them.

A file is read once, into the rules of the one group that counts; what goes to its site's URLs are these rules, and the longest one
that matches is found in the JVM.
"""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = "rules array<struct<allow:boolean,path:string,pattern:string,size:int>>, crawl_delay double, sitemaps array<string>"
KEPT = "!#$&'()*+,-./:;=?@_~%"  # stand in a path as they are


def encoded(path: str) -> str:
    """A path in ASCII, with capital hexadecimal digits."""
    return re.sub(r"%[0-9a-fA-F]{2}", lambda m: m[0].upper(), quote(path, safe=KEPT))


def _rule(allow: bool, path: str) -> dict:
    """A rule as a start of paths, or, where it has wildcards or an end, as a LIKE pattern."""
    path = encoded(path)
    size, ends = len(path), path.endswith("$")
    bare = path.removesuffix("$")
    if not ends and "*" not in bare:
        return {"allow": allow, "path": path, "pattern": None, "size": size}
    like = re.sub(r"\*+", "%", re.sub(r"([\\%_])", r"\\\1", bare))
    return {"allow": allow, "path": None, "pattern": like if ends else like + "%", "size": size}


def _name(agent: str) -> str:
    return agent.split("/")[0].strip().lower()


def read_robots(text: str, agent: str) -> dict:
    """Rules and crawl delay of the agent's groups (of all groups for *, if none names it), and the sitemaps of a file."""
    groups: dict[str, list[dict]] = {}
    delays: dict[str, float] = {}
    sitemaps, names, open_ = [], [], False
    for line in re.split(r"\r\n|\r|\n", text.lstrip("﻿")):
        field, colon, value = line.split("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            names = [*names, _name(value)] if open_ else [_name(value)]
            groups.setdefault(names[-1], [])
        elif field in ("allow", "disallow"):
            for name in names if value else []:
                groups[name].append(_rule(field == "allow", value))
        elif field == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?|\.\d+", value):
            delays |= dict.fromkeys(names, float(value))
        elif field == "sitemap" and value:
            sitemaps.append(value)
        open_ = field == "user-agent"
    own = _name(agent) if _name(agent) in groups else "*"
    return {"rules": groups.get(own, []), "crawl_delay": delays.get(own) or None, "sitemaps": sitemaps}


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """origin, rules, crawl_delay (seconds, null if none), sitemaps of robots (origin, text; one row for each origin); a null text has no rules."""

    @F.pandas_udf(RULES)
    def read(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_robots(t or "", agent) for t in text], columns=["rules", "crawl_delay", "sitemaps"])

    return robots.select(F.lower("origin").alias("origin"), read("text").alias("r")).select("origin", "r.*")


@F.pandas_udf(T.StringType())
def _encoded(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else encoded(p))


def url_path(url: Column) -> Column:
    """Path and query of a URL, in ASCII; URLs that are so already stay in the JVM."""
    bare = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    whole = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    plain = whole.rlike(r"^[!#-;=?-Z_a-z~]*$") & ~whole.rlike("%[0-9A-Fa-f]?[a-f]")
    return F.when(plain, whole).otherwise(_encoded(F.when(~plain, whole)))


def is_allowed(path: Column, rules: Column) -> Column:
    """By the longest rule that matches; of equally long ones, one that allows. Without such a rule all is allowed."""
    met = F.filter(rules, lambda r: F.when(r["pattern"].isNull(), F.startswith(path, r["path"])).otherwise(F.like(path, r["pattern"])))
    best = F.array_max(F.transform(met, lambda r: F.struct(r["size"], r["allow"])))
    return F.coalesce(best["allow"], F.lit(True))


def allowed_urls(urls: DataFrame, robots: DataFrame, agent: str, *, url: str = "url") -> DataFrame:
    """urls with allowed and crawl_delay; robots has origin and text, one row for each origin. Without rules, and for a null URL, all is allowed."""
    rules = robots_rules(robots, agent).select(F.col("origin").alias("__origin"), F.col("rules").alias("__rules"), F.col("crawl_delay").alias("__delay"))
    origin = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1))
    joined = urls.withColumns({"__origin": origin, "__path": url_path(F.col(url))}).join(rules, "__origin", "left")
    return joined.select(*urls.columns, is_allowed(F.col("__path"), F.col("__rules")).alias("allowed"), F.col("__delay").alias("crawl_delay"))
