"""URL functions: normalisation, hashes, hosts, directories, labels."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track visits, and schemes that lead to no page.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "gbraid", "wbraid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gl", "yclid", "igshid", "ref_src"]
NO_PAGE = ("javascript:", "mailto:", "tel:", "data:", "ftp:", "gopher:", "file:", "#")
SYSTEM_PATH = "/cdn-cgi/"

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|]")
_PATH_SAFE = "!$%&'()*+,-./0123456789:;=@ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^_abcdefghijklmnopqrstuvwxyz|~"


def _split(url: str) -> tuple[str, str, str, str, str, str]:
    """Scheme, authority (with //), path, query, fragment as written; queries with their ?."""
    m = _SCHEME.match(url)
    scheme, rest = (m[1].lower(), url[m.end() :]) if m else ("", url)
    rest, _, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    rest = rest.replace("\\", "/")
    authority, path = "", rest
    if rest.startswith("//"):
        end = rest.find("/", 2)
        authority, path = (rest, "") if end < 0 else (rest[:end], rest[end:])
    return scheme, authority, path, mark, query, fragment


def _no_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        if plain == "..":
            if out:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        elif plain == ".":
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def _host(text: str) -> str | None:
    text = unquote(text)
    if text.startswith("["):
        return text.lower() if re.fullmatch(r"\[[0-9A-Fa-f:.]+\]", text) else None
    try:
        host = text.lower() if text.isascii() else text.encode("idna").decode().lower()
    except UnicodeError:
        return None
    return None if not host or _BAD_HOST.search(host) else host


def resolve(url: str, base: str | None = None) -> tuple[str, str, str, str, str] | None:
    """Scheme, credentials, host with port, path, query of an http(s) URL, or None."""
    url = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    scheme, authority, path, mark, query, _ = _split(url)
    if not scheme or (scheme in ("http", "https") and not authority and base is not None and base.lower().startswith(scheme + ":") and not path.startswith("/")):
        above = resolve(base) if base else None
        if above is None:
            return None
        scheme, user, host, old_path, old_query = above
        if not authority:
            if not path and not mark:
                return above
            path = old_path if not path else path if path.startswith("/") else old_path.rsplit("/", 1)[0] + "/" + path
            return scheme, user, host, quote(_no_dots(path), safe=_PATH_SAFE), query
    if scheme not in ("http", "https"):
        return None
    if not authority.lstrip("/"):  # any number of slashes may stand before the host
        authority, _, path = path.lstrip("/").partition("/")
        authority, path = "//" + authority, "/" + path
    user, at, place = authority.lstrip("/").rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", place)
    host = _host(m[1]) if m else None
    if host is None:
        return None
    port = m[2].lstrip("0") or "0" if m[2] else ""
    if port and int(port) > 65535:
        return None
    if port and port != {"http": "80", "https": "443"}[scheme]:
        host += ":" + port
    return scheme, user + at, host, quote(_no_dots(path if path.startswith("/") else "/" + path), safe=_PATH_SAFE), query


def absolute(url: str, base: str | None = None) -> str | None:
    """The URL as a browser would write it, with its query; None if it can't be read."""
    found = resolve(url, base)
    if found is None:
        return None
    scheme, user, host, path, query = found
    return f"{scheme}://{user}{host}{path}" + (f"?{quote(query, safe=_PATH_SAFE + '?`{}')}" if query else "")


def _pair(text: str) -> str:
    return quote(text, safe="*-._ ").replace("~", "%7E").replace(" ", "+")


def normalize(url: str | None, base: str | None = None) -> str | None:
    """The form by which pages are told apart: no fragment, default port or tracking parameter, sorted query, single slashes."""
    if not url or not url.strip() or url.strip().lower().startswith(NO_PAGE):
        return None
    found = resolve(url, base)
    if found is None or found[3].lower().startswith(SYSTEM_PATH):
        return None
    scheme, user, host, path, query = found
    name, colon, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    name = name[:-1] if name.endswith(".") else name
    if not name:
        return None
    pairs = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k.lower() not in TRACKING_PARAMS]
    pairs.sort(key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
    search = "&".join(f"{_pair(k)}={_pair(v)}" for k, v in pairs)
    return f"{scheme}://{user}{name}{colon}{port}{re.sub('/{2,}', '/', path)}" + (f"?{search}" if search else "")


@F.pandas_udf(T.StringType())
def _normalize_udf(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else normalize(u, b) for u, b in zip(url, base, strict=True)], dtype=object)


_PLAIN = r"^https?://[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?:/(?:[A-Za-z0-9_~-][A-Za-z0-9._~-]*/)*(?:[A-Za-z0-9_~-][A-Za-z0-9._~-]*)?)?(?:\?[A-Za-z0-9_.&=-]*)?(?:#.*)?$"


def normalize_plain(url: Column) -> Column:
    """normalize() for absolute URLs of plain ASCII, as an expression."""
    bare = F.regexp_replace(url, "#.*$", "")
    place = F.regexp_extract(bare, r"^([A-Za-z]+://[^/?]+)", 1)
    path = F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]+([^?]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING_PARAMS))
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p"))))
    search = F.array_join(F.transform(keyed, lambda x: x["p"]), "&")
    return F.concat(F.lower(place), F.when(path == "", "/").otherwise(path), F.when(search == "", "").otherwise(F.concat(F.lit("?"), search)))


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """normalize() as a column: plain URLs stay in the JVM, only others go through Python."""
    plain = F.coalesce(url.rlike(_PLAIN) & ~F.lower(url).contains(SYSTEM_PATH), F.lit(False))
    other = _normalize_udf(F.when(~plain, url), F.lit(None).cast("string") if base is None else base)
    return F.when(plain, normalize_plain(url)).otherwise(other)


def url_hash(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def root_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def is_same_site(candidate: Column, origin: Column, follow_subdomains: Column | bool = False) -> Column:
    a, b = host_of(candidate), host_of(origin)
    root = root_host(b)
    below = (a == root) | F.endswith(a, F.concat(F.lit("."), root))
    follow = F.lit(follow_subdomains) if isinstance(follow_subdomains, bool) else follow_subdomains
    return F.coalesce((a != "") & (b != "") & ((a == b) | (root_host(a) == root) | (follow & below)), F.lit(False))


def path_only(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path_only(url), "/"), lambda s: s != "")


def directory_of(url: Column) -> Column:
    """First path segment as /segment; / for the root and for a file at the root."""
    parts = segments(url)
    return F.when(F.size(parts) == 0, "/").when((F.size(parts) == 1) & F.element_at(parts, 1).contains("."), "/").otherwise(F.concat(F.lit("/"), F.get(parts, F.lit(0))))


def path_of(url: Column) -> Column:
    """Path with query; the URL itself if it has no scheme."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.when(found == "", "/").otherwise(found)).otherwise(url)


def label_for_path(url: Column) -> Column:
    """Last path segment, decoded; / for the root."""
    parts = segments(url)
    last = F.get(parts, F.size(parts) - 1)
    return F.when(F.size(parts) == 0, "/").otherwise(F.coalesce(F.try_url_decode(last), last))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def silo_key(url: Column, depth: int = 1) -> Column:
    """Section of a URL: its first depth path segments; / for the root and for pages at the root."""
    parts = segments(url)
    above = F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1))
    return F.when(F.size(parts) <= 1, "/").otherwise(F.concat(F.lit("/"), F.array_join(above, "/")))


# Words that say nothing about a slug's subject.
SLUG_STOP_WORDS = "a al an and by con de del el en for from how la las los of on para por que the to un una with y".split()


def slug_key(url: Column) -> Column:
    """First content word of the last segment, for sites whose pages all lie at the root."""
    parts = segments(url)
    slug = F.regexp_replace(F.lower(F.get(parts, F.size(parts) - 1)), r"\.[a-z0-9]+$", "")
    words = F.filter(F.split(slug, "[-_]+"), lambda w: (F.length(w) > 1) & ~w.isin(SLUG_STOP_WORDS) & ~w.rlike(r"^\d+$"))
    return F.coalesce(F.get(words, F.lit(0)), F.lit("/"))


def is_system_path(url: Column) -> Column:
    p = F.lower(path_only(url))
    return p.rlike(r"^/(cdn-cgi|wp-json|feed|wp-admin|wp-includes)(/|$)") | p.rlike(r"/feed/?$") | p.rlike(r"^/xmlrpc\.php$")
