"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words (a run of spaces and what follows it, parted where letters meet marks if no piece joins these) never merge with one
another, so each distinct word of a batch is encoded once: all its symbols lie in one flat array beside those of the other words,
each round takes the best-ranked leftmost pair of every word at once, merges these pairs and compacts the arrays, until no word
has a pair left. Results of words stay in a bounded cache.

In words of more than LONG symbols (blobs, scripts without spaces) a round merges the best-ranked pair of every stretch. A pair
that no other within the longest piece's length outranks is merged before anything can touch its symbols: whatever symbol takes
one of them in lies inside that stretch, and so does the pair that it started from. Equal pairs of a stretch are merged together
where what they make takes part in no pair as good, of overlapping ones every other from the first on; else the leftmost (as in
runs of spaces, whose pieces are all of one rank). Rounds that merge next to nothing give way to a heap of pairs; all orders give
the same ids.

Null and empty texts have no ids. Any other text is encoded whole. Repeated rows give repeated results. Characters outside the
vocabulary become their UTF-8 bytes' pieces, or the unknown id if the model has none.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, utf8_parts

SPACE = "▁"
LONG = 512
#: Long words whose rounds merge fewer than one pair for so many symbols are finished pair by pair.
FEW = 64
CACHE_WORDS = 400_000
NONE = np.int64(2**62)


class PieceModel:
    """A BPE model with dummy prefix and identity normaliser, from the bytes of a .model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model with identity normaliser and dummy prefix is needed")
        kinds = proto.pieces[0].Type
        self.size = len(proto.pieces)
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces may hold the space mark at their start only")
        self.bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        #: What each id stands for in decoding; control ids stand for nothing.
        self.raw = [b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b" \xe2\x81\x87 " if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        ranks = {s: r for r, s in enumerate(sorted({-p.score for p in proto.pieces if p.type == kinds.NORMAL}))}
        self.symbols = dict(normal)
        for p in normal:
            for c in p:
                self.symbols.setdefault(c, self.size + len(self.symbols))
        #: Any symbol from here on is a character that no piece holds.
        self.foreign = self.size + len(self.symbols)
        self.width = self.foreign + 1
        self.symbol_of = np.full(0x110000, self.foreign, dtype=np.int64)  # by code point
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (ranks[-proto.pieces[i].score], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.reach = max(map(len, normal))
        #: Symbols that, as part of a pair, merge only in a worse rank than they were made in; an equal one further left would come first.
        self.settled = np.ones(self.width, dtype=bool)
        for k, r in zip(self.keys.tolist(), self.ranks.tolist(), strict=True):
            for part in divmod(k, self.width):
                if part < self.size and r <= ranks[-proto.pieces[part].score]:
                    self.settled[part] = False
        self.slots = np.full(1 << 20, -1, dtype=np.int64)  # open addressing: a pair's row in keys
        for i, s in enumerate(self._slot(self.keys).tolist()):
            while self.slots[s] >= 0:
                s = (s + 1) & (len(self.slots) - 1)
            self.slots[s] = i
        self.names = [*map(str, range(self.size))]
        self.split = re.compile(self._word_pattern(normal)).findall
        self.text_of: dict[str, str] = {}
        self.ids_of: dict[str, str] = {}

    @staticmethod
    def _word_pattern(pieces: dict[str, int]) -> str:
        """A word is spaces and what follows them; where no piece joins marks with other characters, it also ends between these."""
        marks = {"\n", "\r", "\t", *string.punctuation}
        beside = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False) if SPACE not in (a, b)}
        while mixed := {c for pair in beside if len(marks.intersection(pair)) == 1 for c in marks.intersection(pair)}:
            marks -= mixed
        kind = re.escape("".join(sorted(marks)))
        return f" *[^ {kind}]+| *[{kind}]+| +" if marks else " *[^ ]+| +"

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they don't merge) and merged symbol of each pair."""
        key = left * self.width + right
        slot = self._slot(key)
        at = self.slots[slot]
        while len(more := np.flatnonzero((at >= 0) & (self.keys[at] != key))):
            slot[more] = (slot[more] + 1) & (len(self.slots) - 1)
            at[more] = self.slots[slot[more]]
        return np.where(at >= 0, self.ranks[at], NONE), self.merged[at]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words hold SPACE for spaces."""
        out: list[list[int]] = [[]] * len(words)
        for long in (False, True):
            some = [i for i, w in enumerate(words) if w and (len(w) > LONG) == long]
            if some:
                self._rounds(words, some, out, long)
        return out

    def _rounds(self, words: list[str], which: list[int], out: list[list[int]], long: bool) -> None:
        """Set the ids in out of the words in which by merge rounds."""
        own = [words[i] for i in which]
        symbol = self.symbol_of[np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        length = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        owner = np.array(which, dtype=np.int64)
        size = np.ones(len(symbol), dtype=np.int64)  # characters that a symbol stands for
        end = np.cumsum(length)
        start = end - length
        rank, merged = np.full(len(symbol), NONE), np.zeros(len(symbol), dtype=np.int64)
        inner = np.ones(len(symbol), dtype=bool)
        inner[end - 1] = False
        at = np.flatnonzero(inner)
        rank[at], merged[at] = self.look_up(symbol[at], symbol[at + 1])
        shift = np.int64(len(symbol).bit_length())
        while len(start):
            best = np.minimum.reduceat(np.where(rank < NONE, (rank << shift) | np.arange(len(symbol)), NONE), start)
            done = best >= NONE
            if done.any():
                over = np.repeat(done, end - start)
                ids, sizes, ends = symbol[over].tolist(), size[over].tolist(), np.cumsum((end - start)[done]).tolist()
                odd = np.maximum.reduceat(symbol, start)[done] >= self.size
                a = 0
                for i, b, x in zip(owner[done].tolist(), ends, odd.tolist(), strict=True):
                    out[i] = self.with_bytes(words[i], ids[a:b], sizes[a:b]) if x else ids[a:b]
                    a = b
            go = ~done
            if long:
                p = self._stretches(rank, merged)
                word = np.searchsorted(start, p, side="right") - 1
            else:
                p, word = best[go] & ((np.int64(1) << shift) - 1), np.flatnonzero(go)
            keep = np.repeat(go, end - start)
            size[p] += size[p + 1]
            symbol[p] = merged[p]
            at_end, at_start = p + 2 == end[word], p == start[word]
            keep[p + 1] = False
            p = (np.cumsum(keep) - 1)[p]
            owner, length = owner[go], ((end - start) - np.bincount(word, minlength=len(start)))[go]
            symbol, size, rank, merged = symbol[keep], size[keep], rank[keep], merged[keep]
            end = np.cumsum(length)
            start = end - length
            rank[p[at_end]] = NONE
            at = np.concatenate([p[~at_end], p[~at_start] - 1])
            rank[at], merged[at] = self.look_up(symbol[at], symbol[at + 1])
            if long and len(p) * FEW < len(symbol):
                for i, a, b in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True):
                    ids, sizes = self._in_order(symbol[a:b].tolist(), size[a:b].tolist())
                    out[i] = self.with_bytes(words[i], ids, sizes)
                return

    def _in_order(self, symbol: list[int], size: list[int]) -> tuple[list[int], list[int]]:
        """The symbols of one word and their sizes after all merges, one by one: best rank first, leftmost among equals."""
        n, pairs, width = len(symbol), self.pairs, self.width
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(x[0], i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (x := pairs.get(symbol[i] * width + symbol[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbol[i] != a or symbol[j] != b:  # one of them has merged since
                continue
            symbol[i], symbol[j] = pairs[a * width + b][1], -1
            size[i] += size[j]
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if x := pairs.get(symbol[i] * width + symbol[k]):
                    heapq.heappush(heap, (x[0], i, symbol[i], symbol[k]))
            if (k := before[i]) >= 0 and (x := pairs.get(symbol[k] * width + symbol[i])):
                heapq.heappush(heap, (x[0], k, symbol[k], symbol[i]))
        live = [i for i in range(n) if symbol[i] >= 0]
        return [symbol[i] for i in live], [size[i] for i in live]

    def _stretches(self, rank: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Places of pairs that no pair within reach outranks."""
        n, reach = len(rank), self.reach
        beside = np.concatenate([np.full(reach, NONE), rank, np.full(reach, NONE)])
        lowest, width = beside, 1  # of so many places from each on
        while 2 * width <= reach:
            lowest, width = np.minimum(lowest[:-width], lowest[width:]), 2 * width
        lowest = np.minimum(lowest[: len(beside) - reach + 1], lowest[reach - width : len(beside) - width + 1])
        before, after = lowest[:n], lowest[reach + 1 : reach + 1 + n]
        good = (rank < NONE) & (rank <= after) & ((rank < before) | (rank == before) & self.settled[merged])
        # In a run of overlapping equals every other counts, up to the first that doesn't.
        at = np.arange(n)
        first = np.ones(n, dtype=bool)
        first[1:] = rank[1:] != rank[:-1]
        first = np.maximum.accumulate(np.where(first, at, 0))
        good &= (np.maximum.accumulate(np.where(good, -1, at)) < first) & ((at - first) % 2 == 0)
        return np.flatnonzero(good)

    def with_bytes(self, word: str, symbols: list[int], sizes: list[int]) -> list[int]:
        """Ids for symbols: characters that are no piece become bytes."""
        if max(symbols, default=0) < self.size:
            return symbols
        ids, at = [], 0
        for s, k in zip(symbols, sizes, strict=True):
            ids += [s] if s < self.size else [self.bytes_of.get(b, self.unknown) for b in word[at].encode()] if self.bytes_of else [self.unknown]
            at += k
        return ids

    def learn(self, words: set[str]) -> None:
        """Take words (with plain spaces) that are not there yet into the caches."""
        new = [*words.difference(self.ids_of)]
        if len(self.ids_of) + len(new) > CACHE_WORDS:
            self.ids_of.clear()
            self.text_of.clear()
            new = [*words]
        names, raw = self.names, self.raw
        for w, ids in zip(new, self.encode_words([w.replace(" ", SPACE) for w in new]), strict=True):
            self.ids_of[w] = ",".join([names[i] for i in ids])
            text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
            self.text_of[w] = w if text == w else text

    def encode_texts(self, texts: list[str | None]) -> tuple[list[str], list[str]]:
        """Ids joined by commas, and the text that they decode to, of each text."""
        split = [self.split(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        ids, decoded, first, held = [], [], 0, 0
        for k in range(len(split) + 1):  # as many texts together as the caches surely hold
            if k == len(split) or k > first and held + len(split[k]) > CACHE_WORDS:
                self.learn(set().union(*split[first:k]))
                ids += [",".join(map(self.ids_of.__getitem__, x)) for x in split[first:k]]
                decoded += ["".join(map(self.text_of.__getitem__, x))[1:] for x in split[first:k]]
                first, held = k, 0
            if k < len(split):
                held += len(split[k])
                if held > CACHE_WORDS:  # one text beyond the caches goes in parts
                    parts = [split[k][a : a + CACHE_WORDS] for a in range(0, len(split[k]), CACHE_WORDS)]
                    some = []
                    for x in parts:
                        self.learn(set(x))
                        some.append((",".join(map(self.ids_of.__getitem__, x)), "".join(map(self.text_of.__getitem__, x))))
                    ids.append(",".join(x for x, _ in some))
                    decoded.append("".join(x for _, x in some)[1:])
                    first, held = k + 1, 0
        return ids, decoded

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the first piece's leading space goes, as it was put there by encoding."""
        text = b"".join(self.raw[i] for i in ids).decode("utf-8", "replace")
        first = next((i for i in ids if self.raw[i]), None)
        return text[1:] if first is not None and text.startswith(" ") and self.raw[first][:1] == b" " and first != self.unknown else text


_MODELS: dict[str, PieceModel] = {}


def load(model: bytes) -> PieceModel:
    """The model, made once for each process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(model)
    return _MODELS[key]


def _batches(batch: pa.RecordBatch, texts: pa.Array, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices with about size bytes of text each."""
    offsets, _ = utf8_parts(texts)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def encode(df: DataFrame, model_path: str, *, column: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """The columns in keep (all but the text, and those named as what is made, if None), n_tokens, and on demand ids (array<int>) and SHA-256 of ids and decoded text."""
    with open(model_path, "rb") as f:
        model = f.read()
    shared = df.sparkSession.sparkContext.broadcast(model)
    made = ("n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests)
    keep = [c for c in df.columns if c != column and c not in made] if keep is None else keep
    fields = [df.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(shared.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for whole in batches:
            for batch in _batches(whole, whole.column(len(keep))):
                joined, decoded = pieces.encode_texts(batch.column(len(keep)).to_pylist())
                count = [s.count(",") + 1 if s else 0 for s in joined]
                columns = [batch.column(i) for i in range(len(keep))] + [pa.array(count, pa.int64())]
                if ids:
                    flat = np.concatenate([np.fromstring(s, dtype=np.int32, sep=",") if s else np.zeros(0, np.int32) for s in joined])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat, pa.int32())))
                if digests:
                    columns += [pa.array([*map(sha, joined)]), pa.array([*map(sha, decoded)])]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(*keep, F.col(column).alias("__text")).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, model_path: str, *, column: str = "ids", into: str = "text") -> DataFrame:
    """df with the text that the ids of a column decode to; null ids give null."""
    with open(model_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.StringType())
    def texts(ids):
        pieces = load(shared.value)
        return ids.map(lambda x: None if x is None else pieces.decode(list(x)))

    return df.withColumn(into, texts(F.col(column)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], ids=False, digests=True)
