"""Main text of web pages from text-to-tag ratios.

A streaming parser (html.parser) turns a page into lines, one for each block of text, with the number of tags met in it. A line's
text-to-tag ratio counts its characters outside links. The ratios are smoothed with a Gaussian kernel and split by 2-means clustering
of their logarithms into content and other lines. Names are a veto only: lines inside navigation, headers, footers, asides, forms,
adverts, notices, comments and hidden elements are no content; no name makes a line content. The content lines select the region:

1. The region is the smallest container that holds every content line, from the first to the last of them.
2. Inside, content lines stay, and so do others whose container holds content too: short paragraphs and headings. A container
   without any content line goes if most of its text is links, as lists of links and buttons for sharing are; else it stays.
3. Without any content line the text is all that no name vetoes.

White space inside a line becomes one space, lines are joined by one space. Null, empty and markup-only pages give an empty
text. Broken markup (unclosed or misplaced tags, a page that breaks off) is read as far as it goes. Repeated rows give repeated
results; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table

SIGMA = 1.5
#: Share of its text outside links that keeps a container without content lines.
PLAIN_SHARE = 0.5

# Element names of HTML by role, and words in class, id and role attributes that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math canvas object iframe head title button select option textarea datalist audio video map dialog".split())
FURNITURE = frozenset("nav footer aside form menu".split())
CONTAINERS = frozenset("html body main article section div header table tbody tr td center blockquote figure ul ol dl details hgroup address fieldset".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption summary th legend hr thead tfoot".split()) | CONTAINERS | FURNITURE
WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav rail footer foot masthead topbar toolbar banner ad ads adv advert adverts advertisement"
    " advertising adsense promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe"
    " subscription signup login share sharing social related recommended recommendations comment comments comentarios kommentare commentaires reply replies respond"
    " discussion disqus pagination pager copyright legal disclaimer skip search widget teaser hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_PART = re.compile(r"[^a-z0-9]+")


def _is_furniture(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id"):
            if any(w in WORDS for c in value.split() for w in (_PART.split(c) if not c.startswith(("has-", "with-", "no-")) else ())):
                return True
        elif name == "role":
            if value.strip() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class LineParser(HTMLParser):
    """Collects lines (text, tags, container, out, characters outside links); containers are numbered, with their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent = [-1]
        #: Open elements: tag, container number, whether page furniture, whether silent.
        self.open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.texts: list[str] = []
        self.tags, self.plain, self.link = 0, 0, False
        self.lines: list[tuple[str, int, int, bool, int]] = []

    def _end_line(self) -> None:
        text = " ".join("".join(self.texts).split())
        if text:
            _, container, out, silent = self.open[-1]
            self.lines.append((text, max(1, self.tags), container, out or silent, min(self.plain, len(text))))
            self.tags = 0
        self.texts, self.plain = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.texts.append("\n")
        elif tag == "a":
            self.link = True
        block = tag in BLOCKS or tag in SILENT
        out = _is_furniture(tag, attrs)
        if tag == "header" and not any(t in ("article", "main") for t, *_ in self.open):
            out = True
        if block or out:
            self._end_line()
            if block and self.open[-1][0] == "p":
                self.open.pop()
            if tag == "li" and self.open[-1][0] == "li":
                self.open.pop()
        if tag not in SILENT:
            self.tags += 1
        if tag in VOID:
            return
        if block or out:
            _, container, above, silent = self.open[-1]
            if tag in CONTAINERS:
                self.parent.append(container)
                container = len(self.parent) - 1
            self.open.append((tag, container, above or out, silent or tag in SILENT))

    def handle_endtag(self, tag: str) -> None:
        if tag not in SILENT:
            self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        if tag in BLOCKS or tag == "a":
            self.link = False
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._end_line()
                del self.open[k:]
                break
            if self.open[k][0] in CONTAINERS and tag not in CONTAINERS and tag not in FURNITURE:
                break  # an inner element's end doesn't close what holds it

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs if tag in VOID else [])
        if tag not in VOID and self.open[-1][0] == tag:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if not self.open[-1][3]:
            self.texts.append(data)
            if not self.link:
                self.plain += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_line()


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel's weight inside counts."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel, "full")[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel, "full")[reach : reach + len(ratio)]


def threshold(ratio: np.ndarray) -> float:
    """The mid-point of two clusters of the logarithms (2-means), or the least positive ratio if they are one."""
    x = np.log1p(ratio)
    low, high = x.min(), x.max()
    if high - low < 0.5:
        return float(ratio[ratio > 0].min(initial=np.inf))
    for _ in range(30):
        cut = (low + high) / 2
        new = x[x <= cut].mean(), x[x > cut].mean()
        if new == (low, high):
            break
        low, high = new
    return float(np.expm1((low + high) / 2))


def is_content(plain: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines have text outside links, and a smoothed text-to-tag ratio in the upper cluster."""
    ratio = smooth(plain / tags)
    return (plain > 0) & (ratio >= threshold(ratio))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    if not parser.lines:
        return ""
    texts, tags, holder, out, plain = (np.array(c, dtype=t) for c, t in zip(zip(*parser.lines, strict=True), (object, float, int, bool, float), strict=True))
    parent, n = parser.parent, len(parser.parent)
    length = np.array([*map(len, texts)], dtype=float)

    def inner(top: np.ndarray) -> np.ndarray:
        """Containers in the given ones, themselves included."""
        held = top.copy()
        for c in range(1, n):  # a container's number is above its parent's
            held[c] |= held[parent[c]]
        return held

    def summed(per_line: np.ndarray) -> np.ndarray:
        total = np.bincount(holder, per_line, minlength=n)
        for c in range(n - 1, 0, -1):
            total[parent[c]] += total[c]
        return total

    content = is_content(plain, tags) & ~out
    if not content.any():
        return " ".join(texts[~out])
    mass = summed(length * content)
    first, last = np.flatnonzero(content)[[0, -1]]
    region = np.zeros(n, dtype=bool)
    region[np.flatnonzero(mass == mass[0])[-1]] = True  # the innermost that holds all of it
    stays = inner(region)[holder]
    stays[:first] &= mass[holder[:first]] > 0
    stays[last + 1 :] &= mass[holder[last + 1 :]] > 0
    whole, outside_links = summed(length), summed(plain)
    without = np.array([c > 0 and mass[c] == 0 and mass[parent[c]] > 0 for c in range(n)])
    links = inner(without & (outside_links < PLAIN_SHARE * whole))
    stays &= content | (~links[holder] & ~out)
    return " ".join(texts[stays])


def extract(df: DataFrame, *, html: str = "html", into: str = "text") -> DataFrame:
    """df without the html column, with the main text and n_chars, its code points."""
    keep = [c for c in df.columns if c not in (html, into, "n_chars")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(into, T.StringType()), T.StructField("n_chars", T.LongType())])
    names = [*keep, into, "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                texts = [main_text(x) for x in some.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=names)

    return df.select(*keep, html).mapInArrow(run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
