"""HTML documents as rows: one Arrow-batched parse gives metadata, headings, text, links, images, structured data, hreflang."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import absolute, resolve

SILENT = frozenset("script style noscript template svg iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAX = {"headings": 200, "images": 500, "schemas": 50, "hreflangs": 100, "candidates": 12, "json": 60_000}

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PARSED = _struct(
    title=_S, meta_description=_S, meta_robots=_S, canonical=_S, language=_S, h1=_S, h1_count=_I, h2_count=_I, word_count=_I, content_hash=_S, text=_S,
    headings=T.ArrayType(_struct(level=_I, text=_S, order=_I)),
    links=T.ArrayType(_struct(href=_S, anchor_text=_S, rel=_S, follow=_B)),
    images=T.ArrayType(_struct(src=_S, alt=_S, has_alt=_B, width=_I, height=_I, loading=_S, srcset=_S, candidates=T.ArrayType(_S))),
    schemas=T.ArrayType(_struct(schema_type=_S, raw_json=_S, valid_json=_B)),
    hreflangs=T.ArrayType(_struct(href=_S, language=_S)),
    has_author=_B, published_date=_S, modified_date=_S, external_citations=_I, text_ratio=T.DoubleType(),
)


def clean(text: str | None) -> str | None:
    return None if text is None else " ".join(text.split()) or None


def parse_srcset(value: str | None) -> list[dict[str, str]]:
    """Candidates of a srcset; URLs may hold commas, so a URL ends at white space only."""
    out, rest = [], value or ""
    while rest := rest.lstrip(" \t\n\r\f,"):
        url, rest = re.match(r"([^ \t\n\r\f]*)(.*)", rest, re.S).groups()  # type: ignore[union-attr]
        descriptor = ""
        if url.endswith(","):
            url = url.rstrip(",")
        else:
            descriptor, _, rest = rest.partition(",")
        if url:
            out.append({"url": url, "descriptor": descriptor.strip()})
    return out


def srcset_urls(value: str | None) -> list[str]:
    return list(dict.fromkeys(c["url"] for c in parse_srcset(value)))


def schema_types(node: object, depth: int = 0) -> list[str]:
    """Values of @type, in lists and @graph to a depth of four."""
    if depth > 4 or not node:
        return []
    if isinstance(node, list):
        return [t for n in node for t in schema_types(n, depth + 1)]
    if not isinstance(node, dict):
        return []
    own = node.get("@type")
    found = [own] if isinstance(own, str) else [t for t in own if isinstance(t, str)] if isinstance(own, list) else []
    return found + (schema_types(node["@graph"], depth + 1) if isinstance(node.get("@graph"), list) else [])


class _Reader(HTMLParser):
    """Gathers what PARSED needs by tag events, without relying on well-formed nesting."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.open = url, []
        self.titles: list[tuple[bool, str]] = []
        self.meta: dict[str, str | None] = {}
        self.canonical: str | None = None
        self.canonical_seen = self.has_author = self.has_body = False
        self.lang: str | None = None
        self.time: str | None = None
        self.headings: list[tuple[int, list[str]]] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.scripts: list[str] = []
        self.hreflangs: list[tuple[str | None, str | None]] = []
        self.body: list[str] = []
        self.capture: dict[str, list] = {}
        self.sources: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {}
        for k, v in attrs:
            a.setdefault(k, v if v is not None else "")
        if tag not in VOID:
            self.open.append(tag)
        if tag == "body":
            self.has_body = True
        if tag == "html":
            self.lang = self.lang or a.get("lang")
        elif tag == "title":
            self.titles.append(("head" in self.open[:-1], ""))
        elif tag == "meta":
            for kind in ("name", "property", "http-equiv"):
                if kind in a and "content" in a:
                    self.meta.setdefault(f"{kind}:{a[kind]}", a["content"])
            self.has_author |= a.get("name") == "author"
        elif tag == "link":
            if a.get("rel") == "canonical" and not self.canonical_seen:
                self.canonical_seen, self.canonical = True, a.get("content", a.get("href"))
            if a.get("rel") == "alternate" and "hreflang" in a:
                self.hreflangs.append((a.get("href"), a["hreflang"]))
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.headings.append((int(tag[1]), []))
            self.capture.setdefault("heading", []).append((tag, self.headings[-1][1]))
        elif tag == "a" and "href" in a:
            self.links.append({"href": a["href"].strip(), "rel": a.get("rel"), "title": a.get("title"), "text": [], "alt": None})
            self.capture.setdefault("a", []).append(("a", self.links[-1]["text"]))
        elif tag == "time" and "datetime" in a and self.time is None:
            self.time = a["datetime"]
        elif tag == "picture":
            self.sources.append([])
        elif tag == "source" and self.sources and "picture" in self.open:
            self.sources[-1] += [*srcset_urls(a.get("srcset", a.get("data-srcset"))), a.get("src", "")]
        elif tag == "img":
            if self.capture.get("a") and self.links[-1]["alt"] is None:
                self.links[-1]["alt"] = a.get("alt")
            self.images.append({"a": a, "picture": self.sources[-1] if self.sources and self.open and self.open[-1] == "picture" else []})
        elif tag == "script" and a.get("type") == "application/ld+json":
            self.scripts.append("")
            self.capture["json"] = [True]
        self.has_author |= a.get("rel") == "author" or a.get("itemprop") == "author"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        if tag == "script":
            self.capture.pop("json", None)
        for kind in ("heading", "a"):
            held = self.capture.get(kind, [])
            if held and held[-1][0] == tag:
                held.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in SILENT and tag not in ("a", "div", "p", "span", "title"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "title" and "svg" not in self.open:
            self.titles[-1] = (self.titles[-1][0], self.titles[-1][1] + data)
        if "json" in self.capture and self.open and self.open[-1] == "script":
            self.scripts[-1] += data
        for kind in ("heading", "a"):
            for _, texts in self.capture.get(kind, []):
                texts.append(data)
        if not SILENT.intersection(self.open) and "head" not in self.open and "title" not in self.open:
            self.body.append(data)


def parse(html: str | None, url: str) -> dict | None:
    """One document as a dict of PARSED's fields; null without a document."""
    if html is None:
        return None
    r = _Reader(url)
    r.feed(html)
    r.close()
    meta = r.meta.get
    text = " ".join("".join(r.body).split())
    headings = [{"level": level, "text": t} for level, texts in r.headings if (t := clean("".join(texts)))]
    for k, h in enumerate(headings):
        h["order"] = k
    page = resolve(url)
    bare = lambda host: re.sub(r"^www\.", "", host.partition(":")[0])
    links, outside = [], 0
    for x in r.links:
        if not x["href"]:
            continue
        rel = clean(x["rel"])
        links.append({"href": x["href"], "anchor_text": clean("".join(x["text"])) or clean(x["alt"]) or clean(x["title"]) or "", "rel": rel, "follow": "nofollow" not in (rel or "").lower().split()})
        target = resolve(x["href"], url)
        outside += bool(page and target and bare(target[2]) != bare(page[2]))
    full = lambda u: absolute(u, url) or u
    images = []
    for x in r.images:
        a = x["a"]
        srcset = clean(a.get("srcset", a.get("data-srcset")))
        raw = [a.get("src"), a.get("data-src"), *srcset_urls(srcset), *x["picture"]]
        candidates = list(dict.fromkeys(full(u.strip()) for u in raw if u and u.strip()))
        if candidates:
            number = lambda v: int(m[1]) if (m := re.match(r"\s*([+-]?\d+)", v or "")) and abs(int(m[1])) < 2**31 else None
            images.append({"src": candidates[0], "alt": a.get("alt"), "has_alt": "alt" in a, "width": number(a.get("width")), "height": number(a.get("height")), "loading": clean(a.get("loading")), "srcset": srcset, "candidates": candidates[: MAX["candidates"]]})
    schemas = []
    for raw in filter(None, map(str.strip, r.scripts)):
        try:
            types: list = schema_types(json.loads(raw)) or [None]
            valid = True
        except ValueError:
            types, valid = [None], False
        schemas += [{"schema_type": t, "raw_json": raw[: MAX["json"]], "valid_json": valid} for t in types]
    canonical = clean(r.canonical)
    h1 = [h["text"] for h in headings if h["level"] == 1]
    title = next((clean(t) for head, t in r.titles if head and clean(t)), None) or next((clean(t) for _, t in r.titles), None)
    first = lambda *keys: next((v for k in keys if (v := meta(k)) is not None), None)
    return {
        "title": title, "meta_description": clean(first("name:description", "property:og:description")), "meta_robots": clean(first("name:robots", "name:googlebot")),
        "canonical": full(canonical) if canonical else None, "language": clean(r.lang) or clean(meta("http-equiv:content-language")),
        "h1": h1[0] if h1 else None, "h1_count": len(h1), "h2_count": sum(h["level"] == 2 for h in headings),
        "word_count": len(text.split()), "content_hash": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest() if text else None, "text": text,
        "headings": headings[: MAX["headings"]], "links": links, "images": images[: MAX["images"]], "schemas": schemas[: MAX["schemas"]],
        "hreflangs": [{"href": full(h), "language": lang[:32]} for href, code in r.hreflangs if (h := clean(href)) and (lang := clean(code))][: MAX["hreflangs"]],
        "has_author": r.has_author or any((s["schema_type"] or "").lower() == "person" or '"author"' in s["raw_json"] for s in schemas),
        "published_date": clean(meta("property:article:published_time")) or clean(r.time),
        "modified_date": clean(meta("property:article:modified_time")) or clean(meta("name:last-modified")),
        "external_citations": outside, "text_ratio": round(len(text) / len(html), 4) if html else 0.0,
    }


def parse_pages(df: DataFrame, html: str = "html", url: str = "url", into: str = "parsed") -> DataFrame:
    """df without its html, with a struct column of PARSED."""
    keep = [c for c in df.columns if c != html]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(into, PARSED)])
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        nonlocal arrow
        arrow = arrow or to_arrow_type(PARSED)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                found = [parse(h, u or "") for h, u in zip(some.column(len(keep)).to_pylist(), some.column(keep.index(url)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(found, arrow)], names=[*keep, into])

    return df.select(*keep, html).mapInArrow(run, schema)


def children(parsed: DataFrame, key: str, field: str, into: str = "parsed") -> DataFrame:
    """A row for each element of one of PARSED's arrays, with the page's key."""
    return parsed.select(key, F.explode(f"{into}.{field}").alias("x")).select(key, "x.*")


# Properties that search engines ask of each type of structured data, required and recommended.
SCHEMA_PROPERTIES = {
    "article": (["headline"], ["image", "datePublished", "dateModified", "author"]),
    "blogposting": (["headline"], ["image", "datePublished", "dateModified", "author"]),
    "newsarticle": (["headline"], ["image", "datePublished", "dateModified", "author"]),
    "product": (["name"], ["image", "offers", "description"]),
    "offer": (["price", "priceCurrency"], ["availability"]),
    "organization": (["name"], ["url", "logo"]),
    "localbusiness": (["name", "address"], ["telephone", "openingHours", "geo"]),
    "breadcrumblist": (["itemListElement"], []),
    "faqpage": (["mainEntity"], []),
    "person": (["name"], []),
    "recipe": (["name"], ["image", "recipeIngredient", "recipeInstructions"]),
    "event": (["name", "startDate"], ["location", "endDate"]),
    "videoobject": (["name", "thumbnailUrl", "uploadDate"], ["description", "duration"]),
    "review": (["reviewRating"], ["author", "itemReviewed"]),
    "website": (["name"], ["url"]),
}


def _nodes(root: object, kind: str, depth: int = 0) -> list[dict]:
    if depth > 5 or not root:
        return []
    if isinstance(root, list):
        return [n for x in root for n in _nodes(x, kind, depth + 1)]
    if not isinstance(root, dict):
        return []
    own = root.get("@type")
    names = [t.lower() for t in (own if isinstance(own, list) else [own]) if isinstance(t, str)]
    return [root] * (kind in names) + (_nodes(root["@graph"], kind, depth + 1) if isinstance(root.get("@graph"), list) else [])


def _filled(value: object) -> bool:
    return value is not None and (bool(value.strip()) if isinstance(value, str) else bool(value) if isinstance(value, list) else True)


def missing_properties(schema_type: str | None, raw: str | None) -> list[dict]:
    """What no node of the declared type has: kind (REQUIRED or RECOMMENDED) and names."""
    wanted = SCHEMA_PROPERTIES.get((schema_type or "").lower())
    if not wanted:
        return []
    try:
        nodes = _nodes(json.loads(raw or ""), schema_type.lower())  # type: ignore[union-attr]
    except ValueError:
        return []
    found = [(kind, [p for p in names if not any(_filled(n.get(p)) for n in nodes)]) for kind, names in zip(("REQUIRED", "RECOMMENDED"), wanted, strict=True)] if nodes else []
    return [{"kind": k, "missing": m} for k, m in found if m]


def extract_json(text: str | None) -> str | None:
    """The JSON document in a model's answer (fenced, embedded or broken off), compact; null if there is none."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", text, re.S)
    for body in ([fenced[1]] if fenced else []) + [text]:
        start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
        if start < 0:
            continue
        body = body[start:]
        try:
            return json.dumps(json.JSONDecoder().raw_decode(body)[0], ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            if (mended := repair_truncated(body)) is not None:
                return mended
    return None


def repair_truncated(body: str) -> str | None:
    """Close what a broken-off document left open, after its last whole element."""
    stack: list[str] = []
    whole: tuple[int, str] | None = None  # the last place where cutting off and closing gives a document
    key = text = escaped = False  # in an object, whether the next string is a key
    for i, c in enumerate(body):
        if text:
            text, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            if not text and not key and stack:
                whole = (i + 1, "".join(reversed(stack)))
        elif c == '"':
            text = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            key = c == "{"
            whole = (i + 1, "".join(reversed(stack)))
        elif c in "}]" and stack:
            stack.pop()
            key = False
            whole = (i + 1, "".join(reversed(stack)))
        elif c == "," and stack:
            key = stack[-1] == "}"
            whole = (i, "".join(reversed(stack)))
        elif c == ":":
            key = False
    for end, closing in [(len(body), "".join(reversed(stack))), *([whole] if whole else [])]:
        try:
            return json.dumps(json.loads(body[:end] + closing), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


@F.pandas_udf(T.ArrayType(_struct(kind=_S, missing=T.ArrayType(_S))))
def missing_properties_udf(schema_type, raw):
    import pandas as pd

    return pd.Series([missing_properties(t, r) for t, r in zip(schema_type, raw, strict=True)])


@F.pandas_udf(_S)
def extract_json_udf(text):
    return text.map(extract_json)


@F.pandas_udf(T.ArrayType(_struct(url=_S, descriptor=_S)))
def parse_srcset_udf(value):
    return value.map(parse_srcset)
