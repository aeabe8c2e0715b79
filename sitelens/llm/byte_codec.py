"""Byte-level BPE: pre-tokenising by an associative scan over classes of code points, cached merging of the slices, decoding by offsets.

Each code point has a class (letter, number, space, other white space, apostrophe, other mark; split further by what follows, where the
pattern looks ahead). A class is a function from states to states of a small automaton. All functions that classes compose to form a
finite monoid, so a scan over the numbers of its elements (pairs are composed by a table, level by level, up and down again) gives the
state at each place of all texts of a batch at once, and with it where slices begin. No regular expression runs.

Distinct slices are merged once, best rank first, leftmost among equals: short ones side by side in flat arrays, a pair of each in a
round; long ones by a heap over linked places, at n log n of their length. Results stay in a bounded cache. Offsets are the first byte of each id's bytes; with them decode() gives the bytes,
or any span of them, back.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?marks|white space before white space or the end|white space, with the
classes of Unicode 16. Null and empty texts have no ids. Texts are handled whole. Bytes that aren't UTF-8 count as marks, one by one.
Repeated rows give repeated results. Other columns pass through; those named as what is made give way to it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, utf8_parts
from .words import parts

CACHE_SLICES = 400_000
#: Bytes of slices that merge side by side.
SHORT = 64
NONE = np.int64(2**31)

# White space; letters and numbers that Unicode 16 adds to 15.1, which this Python has.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# Kinds of code points; from LETTER on those that a contraction may hold.
END, MARK, NUMBER, SPACE, WHITE, APOSTROPHE, LETTER, ONE, R, V, L, E = range(12)
# Classes: the kinds, with R, V and L only where the second letter of a contraction follows, and white space by what follows.
SECOND, LAST_SPACE, LAST_WHITE = 12, 13, 14
# States: nothing yet or a slice that has ended; in letters, numbers, marks; after an apostrophe that begins a slice; in a contraction
# that lacks its second letter; after a space that the next code point joins; in white space.
DONE, IN_LETTERS, IN_NUMBERS, IN_MARKS, IN_APOSTROPHE, IN_CONTRACTION, IN_SPACE, IN_WHITE = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point of a class, and whether a slice begins at it."""
    if kind == END:
        return DONE, False
    if kind in (SPACE, WHITE):
        return IN_WHITE, state != IN_WHITE
    if kind in (LAST_SPACE, LAST_WHITE):  # not white space follows: a slice of its own, or the head of the next one
        return (IN_SPACE if kind == LAST_SPACE else DONE), True
    joined = state == IN_SPACE
    if kind == NUMBER:
        return IN_NUMBERS, not (joined or state == IN_NUMBERS)
    if kind == MARK:
        return IN_MARKS, not (joined or state in (IN_MARKS, IN_APOSTROPHE))
    if kind == APOSTROPHE:
        return (IN_MARKS, False) if joined or state in (IN_MARKS, IN_APOSTROPHE) else (IN_APOSTROPHE, True)
    if state == IN_CONTRACTION:
        return DONE, False
    if state == IN_APOSTROPHE and kind == ONE:
        return DONE, False
    if state == IN_APOSTROPHE and kind == SECOND:
        return IN_CONTRACTION, False
    return IN_LETTERS, not (joined or state == IN_LETTERS)


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class, product table (left first), state that an element leads to from DONE, and whether a slice begins by state and class."""
    classes, states = range(15), range(8)
    functions = {tuple(states): 0}  # the neutral element
    of_class = [functions.setdefault(tuple(_step(s, c)[0] for s in states), len(functions)) for c in classes]
    every = [*functions]
    for f in every:  # grows meanwhile
        for c in of_class:
            g = tuple(every[c][s] for s in f)
            if g not in functions:
                functions[g] = len(functions)
                every.append(g)
    product = np.array([[functions[tuple(g[s] for s in f)] for g in every] for f in every], dtype=np.uint16)
    begins = np.array([[_step(s, c)[1] for c in classes] for s in states])
    return np.array(of_class, dtype=np.uint16), product, np.array([f[DONE] for f in every], dtype=np.uint8), begins


@functools.cache
def _kinds() -> np.ndarray:
    """Kind of every code point."""
    kinds = np.full(0x110000, MARK, dtype=np.uint8)
    first = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], dtype=np.uint8)
    kinds[first == ord("L")], kinds[first == ord("N")] = LETTER, NUMBER
    for new, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in new:
            kinds[a : b + 1] = kind
    kinds[WHITE_SPACE] = WHITE
    kinds[[32, 39]] = SPACE, APOSTROPHE
    kinds[[ord(c) for c in "stmd"]] = ONE
    kinds[[ord(c) for c in "rvle"]] = R, V, L, E
    return kinds


def code_points(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the UTF-8 bytes of some texts and the byte that each begins at; a byte that isn't UTF-8 is one code point, the replacement."""
    n = len(data)
    tail = (data & 0xC0) == 0x80
    at = np.flatnonzero(~tail)
    lead = data[at]
    wide = np.flatnonzero(lead >= 0x80)
    size = 1 + (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
    begins = offsets[(offsets < n)]
    if (not n or at.size and at[0] == 0) and (np.diff(at, append=n) == size).all() and not tail[begins].any() and (lead < 0xF8).all():  # all is UTF-8
        out = lead.astype(np.int64)
        first, some = at[wide], lead[wide].astype(np.int64)
        value = some & (np.int64(0xFF) >> (size[wide] + 1))
        for k in (1, 2, 3):
            on = size[wide] > k
            value[on] = value[on] << 6 | (data[first[on] + k] & 0x3F)
        out[wide] = value
        return np.where(out < 0x110000, out, 0xFFFD), at
    length = np.select([data < 0x80, tail, data < 0xE0, data < 0xF0, data < 0xF8], [1, 0, 2, 3, 4], 0)
    padded = np.concatenate([tail, np.zeros(4, bool)])
    padded[offsets] = False  # what a text lacks isn't taken from the next one
    good = length > 0
    for k in (1, 2, 3):
        more = length > k
        good &= ~more | padded[k : n + k]
    covered = np.zeros(n + 4, dtype=bool)
    for k in (1, 2, 3):
        covered[k : n + k] |= good & (length > k)
    at = np.flatnonzero(good | ~covered[:n])
    wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    size = np.where(good[at], length[at], 0)
    c = [wide[at + k] & 0x3F for k in range(4)]
    out = np.select(
        [size == 1, size == 2, size == 3, size == 4],
        [wide[at], (wide[at] & 0x1F) << 6 | c[1], (wide[at] & 0x0F) << 12 | c[1] << 6 | c[2], (wide[at] & 0x07) << 18 | c[1] << 12 | c[2] << 6 | c[3]],
        0xFFFD,
    )
    return np.where(out < 0x110000, out, 0xFFFD), at


def scan(elements: np.ndarray, product: np.ndarray) -> np.ndarray:
    """The product of all elements before each place."""
    levels, width = [elements], product.shape[0]
    flat = product.ravel()
    while len(levels[-1]) > 1:  # up: products of pairs
        x = levels[-1]
        if len(x) % 2:
            x = levels[-1] = np.append(x, np.uint16(0))
        levels.append(flat[x[::2].astype(np.int32) * width + x[1::2]])
    before = np.zeros(1, dtype=np.uint16)
    for x in levels[-2::-1]:  # down: what is before the left one of a pair is before the pair
        below = np.empty(len(x), dtype=np.uint16)
        before = before[: len(x) // 2]
        below[::2] = before
        below[1::2] = flat[before.astype(np.int32) * width + x[::2]]
        before = below
    return before[: len(elements)]


def slices(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each slice of some texts, and the range of slices (n + 1 offsets) of each text."""
    points, at = code_points(offsets, data)
    edge = np.searchsorted(at, offsets)  # code points before each text
    own = np.arange(len(points)) + np.searchsorted(offsets[1:-1], at, side="right")  # an END behind each text but the last
    kind = np.zeros(len(points) + len(offsets), dtype=np.uint8)
    kind[own] = _kinds()[points]
    follows = np.append(kind[1:], np.uint8(END))
    second = ((kind == R) | (kind == V)) & (follows == E) | (kind == L) & (follows == L)
    outside = (follows != SPACE) & (follows != WHITE) & (follows != END)
    classes = np.where((kind >= R) & (kind <= E), LETTER, kind)
    classes[second] = SECOND
    classes[(kind == SPACE) & outside] = LAST_SPACE
    classes[(kind == WHITE) & outside] = LAST_WHITE
    of_class, product, leads, begins = _monoid()
    state = leads[scan(of_class[classes], product)]
    first = np.flatnonzero(begins[state, classes][own])
    return at[first], np.searchsorted(first, edge)


class Ranks:
    """Byte-level BPE ranks (the bytes of a .tiktoken file), with a cache of merged slices."""

    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError("every byte needs a rank")
        self.raw = {i: b for b, i in self.rank.items()}
        self.names = {i: str(i) for i in self.raw}
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        made = {}
        for token, i in self.rank.items():
            for k in range(1, len(token)):
                left, right = self.rank.get(token[:k]), self.rank.get(token[k:])
                if left is not None and right is not None:
                    made[left << 32 | right] = i
        self.keys, self.made = np.array([*made] or [-1], dtype=np.int64), np.array([*made.values()] or [0], dtype=np.int64)
        self.bits = max(10, (4 * len(made)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)  # open addressing: a pair's place in keys
        for i, at in enumerate(self._slot(self.keys).tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at] = i
        self.cache: dict[bytes, tuple[str, bytes, int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a slice."""
        rank = self.rank
        if piece in rank:
            return [rank[piece]]
        n = len(piece)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        end = [*range(1, n + 1)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] - i != size:  # one of its parts has merged since
                continue
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]] - i))
            if (p := before[i]) >= 0 and (r := rank.get(piece[p : end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i] - p))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = after[i]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of short slices, merged side by side: their symbols lie in one flat array, and each round merges the best pair of every slice, the leftmost of equals."""
        out: list[list[int]] = [[]] * len(pieces)
        symbol = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        end = np.cumsum([*map(len, pieces)])
        start = np.append(0, end[:-1])
        owner = np.arange(len(pieces))
        shift = int(len(symbol)).bit_length()
        rank = np.full(len(symbol), NONE)
        inner = np.ones(len(symbol), dtype=bool)
        inner[end - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.look_up(symbol[at], symbol[at + 1])
        while len(start):
            best = np.minimum.reduceat((rank << shift) | np.arange(len(symbol)), start)
            done = best >= NONE << shift
            if done.any():
                ids = symbol[np.repeat(done, end - start)].tolist()
                a = 0
                for i, size in zip(owner[done].tolist(), (end - start)[done].tolist(), strict=True):
                    out[i] = ids[a : a + size]
                    a += size
            p, go = best[~done] & ((1 << shift) - 1), ~done
            at_end, at_start = p + 2 == end[go], p == start[go]
            symbol[p] = rank[p]  # an id is its rank
            keep = np.repeat(go, end - start)
            keep[p + 1] = False
            p = (np.cumsum(keep) - 1)[p]
            size = (end - start)[go] - 1
            symbol, rank, owner = symbol[keep], rank[keep], owner[go]
            end = np.cumsum(size)
            start = end - size
            rank[p[at_end]] = NONE
            at = np.concatenate([p[~at_end], p[~at_start] - 1])
            rank[at] = self.look_up(symbol[at], symbol[at + 1])
        return out

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what two ids make together, NONE if nothing."""
        key = left << 32 | right
        slot = self._slot(key)
        at = self.slots[slot]
        while len(more := np.flatnonzero((at >= 0) & (self.keys[at] != key))):
            slot[more] = (slot[more] + 1) & (len(self.slots) - 1)
            at[more] = self.slots[slot[more]]
        return np.where(at >= 0, self.made[at], NONE)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def learn(self, pieces: set[bytes]) -> None:
        """Take slices that aren't there yet into the cache: ids joined by commas, what they decode to, and their number."""
        new = [*pieces.difference(self.cache)]
        if len(self.cache) + len(new) > CACHE_SLICES:
            self.cache.clear()
            new = [*pieces]
        short = [p for p in new if len(p) <= SHORT and p not in self.rank]
        raw, cache, names = self.raw, self.cache, self.names
        for p, ids in zip(short, self.merge_all(short) if short else [], strict=True):
            cache[p] = (",".join([names[i] for i in ids]), b"".join([raw[i] for i in ids]), len(ids))
        for p in new:
            if p not in cache:
                ids = self.merge(p)
                cache[p] = (",".join([names[i] for i in ids]), b"".join([raw[i] for i in ids]), len(ids))

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[list[tuple[str, bytes, int]]]:
        """For each text its slices' ids (joined by commas), decoded bytes and number of ids."""
        first, rows = slices(offsets, data)
        flat, edge = data.tobytes(), [*first.tolist(), len(data)]
        pieces = [flat[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        held = 0  # slices up to here are in the cache
        for a, b in zip(rows.tolist(), rows[1:].tolist(), strict=False):
            found: list[tuple[str, bytes, int]] = []
            while a < b:
                if a >= held:
                    held = min(a + CACHE_SLICES, len(pieces))
                    self.learn(set(pieces[a:held]))
                found += map(self.cache.__getitem__, pieces[a : min(b, held)])
                a = min(b, held)
            yield found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])


_RANKS: dict[str, Ranks] = {}


def load(ranks: bytes) -> Ranks:
    """The ranks, made once for each process."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _RANKS:
        _RANKS[key] = Ranks(ranks)
    return _RANKS[key]


def encode(df: DataFrame, ranks_path: str, *, column: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """The columns in keep (all but the text, and those named as what is made, if None), n_tokens, on demand ids and offsets (of the first
    byte of each id; arrays of int), and SHA-256 of the ids and of the bytes that they decode to."""
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    made = ["n_tokens", *["ids", "offsets"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    keep = [c for c in df.columns if c != column and c not in made] if keep is None else keep
    fields = [df.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in made[1 : 1 + 2 * ids]] + [T.StructField(c, T.StringType()) for c in made[1 + 2 * ids :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(shared.value)
        sizes = np.zeros(max(ranks.raw) + 1, dtype=np.int64)
        sizes[[*ranks.raw]] = [*map(len, ranks.raw.values())]
        for whole in batches:
            offsets, data = utf8_parts(whole.column(len(keep)))
            for a, b in parts(offsets, 1 << 20):
                counts, every, starts, digest = [], [], [], []
                for found in ranks.encode(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]):
                    joined = ",".join([x[0] for x in found])
                    counts.append(sum([x[2] for x in found]))
                    if ids:
                        every.append(np.fromstring(joined, dtype=np.int32, sep=",") if joined else np.zeros(0, np.int32))
                        starts.append(np.cumsum(sizes[every[-1]]) - sizes[every[-1]])
                    if digests:
                        digest.append((hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(b"".join([x[1] for x in found])).hexdigest()))
                columns = [whole.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(counts, pa.int64())]
                if ids:
                    edge = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                    columns += [pa.ListArray.from_arrays(edge, pa.array(np.concatenate(x), pa.int32())) for x in (every, starts)]
                if digests:
                    columns += [pa.array([x[k] for x in digest], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(*keep, F.col(column).alias("__text")).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, ranks_path: str, *, column: str = "ids", offsets: str = "offsets", into: str = "bytes", start: int | None = None, end: int | None = None) -> DataFrame:
    """df with the bytes (binary) that the ids of a column decode to; with start or end only what lies between these bytes, for which only
    the ids that the offsets name are looked at. Null ids give null."""
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.BinaryType())
    def texts(ids, places):
        ranks = load(shared.value)

        def one(x, at):
            if x is None:
                return None
            if start is None and end is None:
                return ranks.decode(list(x))
            low = max(int(np.searchsorted(at, start or 0, side="right")) - 1, 0)
            high = len(at) if end is None else int(np.searchsorted(at, end, side="left"))
            skip = (start or 0) - int(at[low]) if len(at) else 0
            return ranks.decode(list(x[low:high]))[skip:][: None if end is None else max(end - (start or 0), 0)]

        return ids.combine(places, one) if len(ids) else ids

    return df.withColumn(into, texts(F.col(column), F.col(offsets)))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id"], ids=False, digests=True)
