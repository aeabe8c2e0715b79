"""Periodic runs of words: stretches that repeat a passage of q words, found by the linear tandem-repeat method of Gusfield and Stoye.

The words of a batch of documents lie in one flat array. Ranks of all factors of 1, 2, 4, ... words (doubling, only factors that occur
twice are refined) give the suffix array and the longest common extension of any two places, to the right and to the left. Then:

1. The Lempel-Ziv blocks of the text. For each block, squares whose centre lies in it are looked for at its two ends only: what is
   found covers the leftmost occurrence of every square. Squares of a root that is itself a repetition are left out.
2. From each of these, suffix links (of the leaf, then up to where the tree is as deep as the square is long) lead to the squares
   that begin one word later, as long as the period holds. The places in the tree are the vocabulary of squares.
3. All leaves below a place are its occurrences. Occurrences of one period at consecutive words merge into a run.

Documents in which no four words in a row occur twice hold no run (of 12 words or more) and skip these steps: word hashes tell, which
may take too many documents as candidates but lose none. From there on words are compared as bytes, not as hashes.

A word is a run of bytes other than space and 0x09-0x0D. Null and empty texts, and texts of white space, have no word and no run.
Runs may overlap; a run has the smallest period of its stretch. Long texts are handled whole: memory is n log n of their words.
Repeated rows give repeated results. Other columns pass through; those named as what is made give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, utf8_parts
from .words import mix, parts, shingles, word_hashes

MIN_LENGTH = 12
#: Any run of MIN_LENGTH words and of two periods has a factor of so many words twice.
SEED = 4
RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


class Factors:
    """Suffix array, and equality of the factors of 2^k symbols (levels[k]), of a sequence of integers from 0 on."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        self.levels: list[np.ndarray] = []
        rank = np.full(n + 1, -1, dtype=np.int64)
        active, key = np.arange(n), symbols.astype(np.int64)
        base, width = np.zeros(n, dtype=np.int64), 0  # of the group that a place is in: its first rank
        while True:
            order = np.argsort(key, kind="stable")
            active, key, base = active[order], key[order], base[order]
            at = np.arange(len(active))
            new = np.ones(len(active), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            older = np.ones(len(active), dtype=bool)
            older[1:] = base[1:] != base[:-1]
            first = np.maximum.accumulate(np.where(new, at, 0))
            rank = rank.copy()
            rank[active] = base + first - np.maximum.accumulate(np.where(older, at, 0))
            alone = new & np.append(new[1:], True)
            active = active[~alone]
            if not len(active) and self.levels:
                break
            self.levels.append(rank.astype(np.int32))
            if not len(active):
                break
            width = max(2 * width, 1)
            base = rank[active]
            key = base * (n + 1) + rank[np.minimum(active + width, n)] + 1
        self.rank = rank[:n]
        self.places = np.empty(n, dtype=np.int64)
        self.places[self.rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what is equal from places i and j on (i and j differ, up to n)."""
        out = np.zeros(len(i), dtype=np.int64)
        on = np.flatnonzero((i < self.n) & (j < self.n))
        on = on[self.levels[0][i[on]] == self.levels[0][j[on]]]
        i, j = i[on], j[on]
        got = np.zeros(len(on), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][i + got] == self.levels[k][j + got]
            got += same.astype(np.int64) << k
        out[on] = got
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what is equal up to places i and j, these included (from -1 on)."""
        got = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i + 1 - got - (1 << k), j + 1 - got - (1 << k)
            same = (a >= 0) & (b >= 0)
            same[same] = self.levels[k][a[same]] == self.levels[k][b[same]]
            got += same.astype(np.int64) << k
        return got

    def blocks(self) -> np.ndarray:
        """First places of the Lempel-Ziv blocks: each is the longest factor that begins earlier too, or one new symbol."""
        n = self.n
        below, above = [*range(-1, n - 1)], [*range(1, n + 1)]
        for r in self.rank[::-1].tolist():  # what is left of the suffix array's list when a place is the last one: its earlier neighbours
            b, a = below[r], above[r]
            if b >= 0:
                above[b] = a
            if a < n:
                below[a] = b
        size = np.ones(n, dtype=np.int64)
        for near in (np.array(below), np.array(above)):
            some = np.flatnonzero((near >= 0) & (near < n))
            place = self.places[some]
            size[place] = np.maximum(size[place], self.ahead(place, self.places[near[some]]))
        step, at, out = size.tolist(), 0, []
        while at < n:
            out.append(at)
            at += step[at]
        return np.array(out, dtype=np.int64)

    def covering(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and root lengths of squares, among them the first of a stretch that covers each square's leftmost occurrence."""
        start = self.blocks()
        end = np.append(start[1:], self.n)
        size = end - start
        found = []
        for at_end in (True, False):
            count = size if at_end else size + np.append(size[1:], 0)
            h = np.repeat(end if at_end else start, count)
            k = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count) + 1
            q = h - k if at_end else h + k
            inside = (h < self.n) & (q < self.n)
            h, k, q = h[inside], k[inside], q[inside]
            some = self.levels[0][h] == self.levels[0][q]
            h, k, q = h[some], k[some], q[some]
            right, left = self.ahead(h, q), self.behind(h - 1, q - 1)
            low = np.minimum(h, q)
            good = right + left >= k
            found.append((np.maximum(low - left, low - k + 1)[good], k[good]))
        place, k = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = np.unique(place * (self.n + 1) + k)
        place, k = keep // (self.n + 1), keep % (self.n + 1)
        primitive = np.ones(len(k), dtype=bool)
        factor = _least_factors(int(k.max(initial=1)))
        rest = k.copy()
        while (some := np.flatnonzero(primitive & (rest > 1))).size:
            prime = factor[rest[some]]
            part = k[some] // prime
            primitive[some] = self.ahead(place[some], place[some] + part) < k[some] - part
            while (more := rest[some] % prime == 0).any():
                rest[some] = np.where(more, rest[some] // prime, rest[some])
        return place[primitive], k[primitive]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, length and smallest period of every run of two periods or more, by place, then period."""
        place, k = self.covering()
        # Suffix links, one word at a time, while the period lasts; a root has k rotations.
        count = np.minimum(self.ahead(place, place + k) - k, k - 1) + 1
        place = np.repeat(place, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        k = np.repeat(k, count)
        low, high = self._below(self.rank[place], 2 * k)
        keep = np.unique(low * (self.n + 1) + k, return_index=True)[1]
        low, high, k = low[keep], high[keep], k[keep]
        count = high - low + 1
        where = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        place, k = self.places[where], np.repeat(k, count)
        order = np.lexsort((place, k))
        place, k = place[order], k[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (place[1:] != place[:-1] + 1)
        last = np.append(new[1:], True)[: len(k)]
        start, period = place[new], k[new]
        length = place[last] + 2 * k[last] - start
        order = np.lexsort((period, start))
        return start[order], length[order], period[order]

    def _below(self, leaf: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf below the shallowest place above a leaf that is depth symbols deep."""
        common = np.zeros(self.n + 1, dtype=np.int64)  # of a leaf with the one before it
        common[1 : self.n] = self.ahead(self.places[:-1], self.places[1:])
        least = [common]
        while 1 << len(least) <= self.n + 1:
            w = 1 << len(least) - 1
            least.append(np.minimum(least[-1][:-w], least[-1][w:]))
        low, high = leaf.copy(), leaf.copy()
        for k in range(len(least) - 1, -1, -1):
            w = 1 << k
            at = low - w + 1
            go = at >= 0
            go[go] = least[k][at[go]] >= depth[go]
            low -= go.astype(np.int64) << k
            go = high + w < self.n
            go[go] = least[k][high[go] + 1] >= depth[go]
            high += go.astype(np.int64) << k
        return low, high


def _least_factors(n: int) -> np.ndarray:
    """The smallest prime factor of each number up to n."""
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            multiples = out[p * p :: p]
            multiples[multiples == np.arange(p * p, n + 1, p)] = p
    return out


def _candidates(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows in which a factor of SEED words has the hash of another one."""
    seeds, ranges = shingles(hashes, rows, SEED, whole=False)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(ranges))
    key = seeds ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    twice = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return np.unique(np.concatenate([row[order[twice]], row[order[twice + 1]]]))


def _symbols(data: bytes, first: list[int], last: list[int], row: np.ndarray) -> np.ndarray:
    """One number for each word of each row: equal within a row if the bytes are equal, never equal in two rows."""
    known: dict[bytes, int] = {}
    word = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(first, last, strict=True)], dtype=np.int64)
    return np.unique(row * (len(known) + 1) + word, return_inverse=True)[1]


def batch_runs(offsets: np.ndarray, data: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start (word of the row), length and period of the runs of some texts; first and end byte of every word, and each row's words."""
    hashes, first, last, rows = word_hashes(offsets, data, lower=False)
    found = [np.zeros((4, 0), dtype=np.int64)]
    some = _candidates(hashes, rows) if min_length >= 2 * SEED else np.flatnonzero(np.diff(rows))
    if len(some):
        count = np.diff(rows)[some]
        at = np.arange(int(count.sum())) + np.repeat(rows[some] - np.cumsum(count) + count, count)
        begin, size = np.cumsum(count) - count, min_length
        symbols = _symbols(data.tobytes(), first[at].tolist(), last[at].tolist(), np.repeat(np.arange(len(some)), count))
        start, length, period = Factors(symbols).runs()
        long = length >= size
        own = np.searchsorted(begin, start, side="right") - 1
        found.append(np.stack([some[own], start - begin[own], length, period])[:, long])
    row, start, length, period = np.concatenate(found, axis=1)
    return row, start, length, period, first, last, rows


def _joined(data: np.ndarray, first: np.ndarray, last: np.ndarray, rows: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """The kept words of each row, joined by one space."""
    n = len(first)
    size = np.where(kept, last - first + 1, 0)
    total = np.concatenate([[0], np.cumsum(size)])
    some = np.flatnonzero(kept)
    out = np.full(int(total[-1]), 32, dtype=np.uint8)
    mask = np.ones(len(out), dtype=bool)
    mask[total[some + 1] - 1] = False  # a space behind each word
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[first[some]] += 1
    inside[last[some]] -= 1
    out[mask] = data[np.cumsum(inside[:-1]).astype(bool)] if n else out[mask]
    flat, edge = out.tobytes(), total[rows].tolist()
    return [flat[a : b - 1] if b > a else b"" for a, b in zip(edge, edge[1:], strict=False)]


def find_runs(df: DataFrame, *, column: str = "text", keep: list[str] | None = None, min_length: int = MIN_LENGTH, runs: bool = True, collapsed: bool = True, digests: bool = False) -> DataFrame:
    """The columns in keep (all but the text, and those named as what is made, if None), n_runs and the longest run (start, length, period),
    on demand all runs (array), the text in which each run keeps its first period only, and SHA-256 of both."""
    made = ["n_runs", "start", "length", "period", *["runs"] * runs, *["collapsed"] * collapsed, *["runs_sha256", "collapsed_sha256"] * digests]
    keep = [c for c in df.columns if c != column and c not in made] if keep is None else keep
    fields = [df.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in made[:4]]
    fields += [T.StructField("runs", RUN)] * runs + [T.StructField(c, T.StringType()) for c in made[4 + runs :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            offsets, data = utf8_parts(whole.column(len(keep)))
            for a, b in parts(offsets, 1 << 20):
                columns = _columns(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                yield pa.RecordBatch.from_arrays([whole.column(i).slice(a, b - a) for i in range(len(keep))] + columns, names=[f.name for f in fields])

    def _columns(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
        row, start, length, period, first, last, rows = batch_runs(offsets, data, min_length)
        n = len(offsets) - 1
        count = np.bincount(row, minlength=n)
        order = np.lexsort((period, start, -length, row))
        best = np.full((3, n), -1, dtype=np.int64)
        head = order[np.cumsum(count[count > 0]) - count[count > 0]]
        best[:, count > 0] = np.stack([start, length, period])[:, head]
        out = [pa.array(count, pa.int64()), *(pa.array(x, pa.int64(), mask=x < 0) for x in best)]
        edge = np.concatenate([[0], np.cumsum(count)])
        if runs:
            flat = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=[pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])
            out.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), flat))
        if collapsed or digests:
            gone = np.zeros(len(first) + 1, dtype=np.int64)
            np.add.at(gone, rows[row] + start + period, 1)
            np.subtract.at(gone, rows[row] + start + length, 1)
            texts = _joined(data, first, last, rows, np.cumsum(gone[:-1]) == 0)
            if collapsed:
                out.append(pc.cast(pa.array(texts, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True)))
        if digests:
            lines = ["%d,%d,%d\n" % x for x in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
            out.append(pa.array([hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)], pa.string()))
            out.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()))
        return out

    return df.select(*keep, F.col(column).alias("__text")).mapInArrow(run, T.StructType(fields))


def with_planted_runs(key: Column, text: Column) -> Column:
    """The text of a tenth of all keys with a periodic tail: from word a on, word i becomes word a + (i - a) % p. Other texts stay."""
    h = F.crc32(key.cast("string").cast("binary"))
    words = F.filter(F.split(text, "[ \t\n\x0b\f\r]+", -1), lambda w: w != "")
    g, n = F.floor(h / 10), F.size(words)
    a = g % F.greatest(n, F.lit(1))
    p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), times))
    changed = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs, keep=["doc_id"], runs=False, collapsed=False, digests=True)
    return found.withColumn("exponent_milli", F.expr("1000 * length div period"))
