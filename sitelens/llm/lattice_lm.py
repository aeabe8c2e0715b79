"""Subword lattice language model: document probability summed over all segmentations.

The vocabulary is an existing tokenizer's pieces; their scores are the logarithms of their shares in the training rows' words.
A word's probability sums over all ways to cut it into pieces (and bytes, for characters that are no piece), by a forward
recursion in log space; as every word starts with a piece that holds the space mark, the words' probabilities multiply to the
marginal over all segmentations of the document: lattice_score.

score is the marginal of a larger lattice over the same pieces. Each training word is one more arc over the whole word, weighted
by its count less a discount; the discounts' mass scales the pieces' paths. Besides, each earlier occurrence of the word in the
document is an arc of weight 1 against CONCENTRATION for all the others (words that a document has used come up again). The sum
over all paths factors into words and has a closed form for each (a ratio of gamma functions). The length is geometric. The tests
add up all paths of whole documents.

rest_score is the same without the arcs of the document's own words, and with a training document's own counts taken off: what
all other documents say of it. Of a document that occurs twice the copy still knows every word.

What is learned from the corpus is the counts of all words of all training rows. Each distinct word goes through the lattice once.
The most frequent words, at most HEAD, go to every task; the rest stay in a table and are joined to the documents' rare words.

Null texts count as empty; an empty text has the end as its one token. Without training rows every word is unknown, the pieces
are equally likely and no discount is taken. Repeated rows are scored each. A null id counts as a training row.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, remainder_is, table, utf8_parts

HEAD = 200_000
CONCENTRATION = 2000.0
FLUSH = 300_000
#: Stands for the end of a document among the words; no word holds a space.
END = " "
LN10 = math.log(10)


def _words(batch: pa.RecordBatch, place: int) -> Iterator[list[bytes]]:
    offsets, data = utf8_parts(batch.column(place))
    whole, ends = data.tobytes(), offsets.tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield whole[a:b].lower().split()


def word_counts(docs: DataFrame, text: str, held: str) -> DataFrame:
    """word, n over all words of docs, with END for the documents; rows where held is true give their words with a count of 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()).cast(pa.string()), pa.array([*seen.values()], pa.int64())], names=["word", "n"])
            seen.clear()
            return found

        for batch in batches:
            for words, unused in zip(_words(batch, 0), batch.column(1).to_pylist(), strict=True):
                if unused:
                    seen.update(dict.fromkeys(words, 0))
                else:
                    seen.update(words)
                    seen[END.encode()] += 1
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    return docs.select(text, held).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(counts: DataFrame, model: bytes) -> dict[int, float]:
    """How often each piece occurs in the words; as many rows as the vocabulary at most."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        held: Counter[int] = Counter()
        for batch in batches:
            for ids, n in zip(pieces.encode(batch.column(0).to_pylist(), num_threads=1), batch.column(1).to_pylist(), strict=True):
                for i in ids:
                    held[i] += n
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([*held.values()], pa.int64())], names=["piece", "n"])

    rows = counts.where((F.col("word") != END) & (F.col("n") > 0)).mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in rows}


class Lattice:
    """Log probabilities of words over a vocabulary's pieces."""

    def __init__(self, model: bytes, counts: dict[int, float], smoothing: float = 0.1):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        usable = [i for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i))]
        total = math.log(sum(counts.get(i, 0) + smoothing for i in usable))
        score = {i: math.log(counts.get(i, 0) + smoothing) - total for i in usable}
        #: Scores of pieces; None for what only starts one.
        self.scores: dict[str, float | None] = {}
        self.bytes = [0.0] * 256
        for i in usable:
            p = pieces.id_to_piece(i)
            if pieces.is_byte(i):
                self.bytes[int(p[3:5], 16)] = score[i]
            else:
                self.scores[p] = score[i]
        for p in [*self.scores]:
            for k in range(1, len(p)):
                self.scores.setdefault(p[:k], None)

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the sum over all segmentations."""
        s = "▁" + word
        n, get, exp, log1p = len(s), self.scores.get, math.exp, math.log1p
        forward: list[float | None] = [None] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i]
            if here is None:
                continue
            end = i + 1
            while end <= n:
                score = get(s[i:end], False)
                if score is False:
                    break
                if score is not None:
                    v, o = here + score, forward[end]
                    forward[end] = v if o is None else v + log1p(exp(o - v)) if v > o else o + log1p(exp(v - o))
                end += 1
            if get(s[i]) is None:
                v, o = here + sum(self.bytes[b] for b in s[i].encode("utf-8", "replace")), forward[i + 1]
                forward[i + 1] = v if o is None else max(v, o) + log1p(exp(-abs(v - o)))
        return forward[n]  # type: ignore[return-value]


_SHARED: dict[str, object] = {}


def _once(key: str, make: Callable[[], object]) -> object:
    """make() once for each key and process; the one before goes."""
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = make()
    return _SHARED[key]


class Model:
    """What is learned from the rows of docs where held is false: counts and lattice probabilities of all words, totals, the most frequent words."""

    def __init__(self, docs: DataFrame, text: str, held: str, model: bytes, head: int = HEAD, concentration: float = CONCENTRATION):
        spark = docs.sparkSession
        counts = cut(word_counts(docs, text, held), "word-counts")
        power = F.floor(F.log2("n") + 1e-9).cast("int")
        by_power = counts.where("n > 0").groupBy(power.alias("power")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("ends"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        rows = sorted(by_power.collect(), key=lambda r: -r["power"])  # 64 at most
        total = lambda c: sum(r[c] or 0 for r in rows)
        self.tokens, self.types, self.ends = total("n"), total("words"), total("ends")
        n1, n2 = total("n1"), total("n2")
        self.discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        words, types = self.tokens - self.ends, self.types - (self.ends > 0)
        self.words = words
        self.rest = self.discount * types / words if words else 1.0
        self.end = (self.ends + 1) / (self.tokens + 2)
        self.concentration = concentration
        self.base = self.tokens + self.types + 1
        self.least, held_so_far = 1, 0
        for r in rows:
            if held_so_far + r["words"] > head:
                self.least = 2 ** (r["power"] + 1)
                break
            held_so_far += r["words"]
        pieces = spark.sparkContext.broadcast((model, piece_counts(counts, model)))

        def with_lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*pieces.value)
            for batch in batches:
                found = [lattice.log_probability(w) for w in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["word", "n", "lp"])

        self.counts = cut(counts.where(F.col("word") != END).mapInArrow(with_lattice, "word string, n long, lp double"), "word-scores")
        discard(counts)
        frequent = self.counts.where(F.col("n") >= self.least).toArrow()  # HEAD rows at most
        self.head = spark.sparkContext.broadcast((frequent.column("word").to_pylist(), frequent.column("n").to_pylist(), frequent.column("lp").to_pylist()))

    def score(self, docs: DataFrame, key: str, text: str, held: str) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score and rest_score of docs."""
        a, base, discount, words_n, rest = self.concentration, self.base, self.discount, max(self.words, 1), self.rest
        end_n, log_end, log_on = self.ends, math.log(self.end), math.log1p(-self.end)
        head, token = self.head, uuid.uuid4().hex
        names = ["rk", "word", "tf", "own", "others", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "lattice", "rest"]
        schema = "rk long, word string, tf int, own int, others long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, lattice double, rest double"
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * 4]

        def frequent() -> dict[bytes, tuple[float, float, float, float, int]]:
            out = {}
            for w, n, lp in zip(*head.value, strict=True):
                ap = a * (max(n - discount, 0) / words_n + rest * math.exp(lp))
                out[w.encode()] = (math.log(ap), ap, math.log10((n + 1) / base), lp, n)
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _once(token, frequent).get  # type: ignore[attr-defined]
            lgamma, log, exp = math.lgamma, math.log, math.exp
            context = TaskContext.get()
            rk = (context.partitionId() if context else 0) << 33
            for batch in batches:
                ids, unused = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                cells: list[list] = [[] for _ in names]
                tails: tuple[list, ...] = ([], [], [], [], [])
                for k, words in enumerate(_words(batch, 1)):
                    rk += 1
                    own = 0 if unused[k] else 1
                    others = max(words_n - own * len(words), 1)  # training words outside this document
                    base_sum = math.log10((end_n + 1) / base)
                    score_sum = log_end + len(words) * log_on + lgamma(a) - lgamma(a + len(words))
                    lattice_sum = rest_sum = log_end + len(words) * log_on
                    n_known = int(end_n > 0)
                    for w, tf in Counter(words).items():
                        h = known(w)
                        if h is None:
                            for c, v in zip(tails, (rk, w, tf, own, others), strict=True):
                                c.append(v)
                        else:
                            log_ap, ap, b, lp, n = h
                            n_known += tf
                            base_sum += tf * b
                            lattice_sum += tf * lp
                            left = n - own * tf - discount
                            rest_sum += tf * (log(left / others + rest * exp(lp)) if left > 0 else log(rest) + lp)
                            score_sum += log_ap if tf == 1 else log_ap + (log(ap + 1) if tf == 2 else lgamma(ap + tf) - lgamma(ap + 1))
                    for c, v in zip(cells, (rk, b" %d" % rk, 0, own, others, ids[k], unused[k], len(words) + 1, n_known, base_sum, score_sum, lattice_sum, rest_sum), strict=True):
                        c.append(v)
                    if len(tails[0]) > 50_000 or k + 1 == batch.num_rows:
                        whole = [[*c, *t] for c, t in zip(cells[:5], tails, strict=True)] + [c + [None] * len(tails[0]) for c in cells[5:]]
                        arrays = [pa.array(c, pa.binary()).cast(t) if i == 1 else pa.array(c, t) for i, (c, t) in enumerate(zip(whole, types, strict=True))]
                        yield pa.RecordBatch.from_arrays(arrays, names=names)
                        cells, tails = [[] for _ in names], ([], [], [], [], [])

        rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held).mapInArrow(run, schema)
        rare = self.counts.where(F.col("n") < self.least)
        n, tf = F.coalesce("n", F.lit(0)), F.col("tf")
        p = F.greatest(n - discount, F.lit(0.0)) / words_n + rest * F.exp("lp")
        log_ap = F.when(n == 0, F.lit(math.log(a * rest)) + F.col("lp")).otherwise(F.log(a * p))
        more = F.when(tf > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(tf - 1, F.lit(1))), F.lit(0.0), lambda s, j: s + F.log(a * p + j))).otherwise(0.0)
        left = n - tf * F.col("own") - discount
        log_rest = F.when(left > 0, F.log(left / F.col("others") + rest * F.exp("lp"))).otherwise(F.lit(math.log(rest)) + F.col("lp"))
        is_word = tf > 0
        each = rows.join(rare, "word", "left").select(
            "rk", "doc_id", "held_out", "n_tokens",
            F.when(is_word, F.when(n > 0, tf).otherwise(0).cast("long")).otherwise(F.col("n_known")).alias("n_known"),
            F.when(is_word, tf * F.log10((n + 1) / base)).otherwise(F.col("base")).alias("base"),
            F.when(is_word, log_ap + more).otherwise(F.col("score")).alias("score"),
            F.when(is_word, tf * F.col("lp")).otherwise(F.col("lattice")).alias("lattice"),
            F.when(is_word, tf * log_rest).otherwise(F.col("rest")).alias("rest"),
        )
        out = each.groupBy("rk").agg(*(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")), *(F.sum(c).alias(c) for c in ("n_known", "base", "score", "lattice", "rest")))
        logs = [(F.col(c) / LN10).alias(name) for c, name in (("score", "score"), ("lattice", "lattice_score"), ("rest", "rest_score"))]
        return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), *logs)


def score_documents(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", modulus: int = 7, held_out: int = 2) -> DataFrame:
    """Scores of all docs by a model learned from those whose crc32 remainder isn't held_out.

    Rows are numbered by their place in their partition, so docs is a table that is read (cut() others first): a task that runs
    again must find the same rows in the same order.
    """
    with open(model_path, "rb") as f:
        pieces = f.read()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), remainder_is(key, modulus, held_out).alias("held"))
    return Model(rows, "text", "held", pieces).score(rows, "id", "text", "held")


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
