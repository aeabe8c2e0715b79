"""Quality classifier as a sparse ensemble of rules over text statistics.

Shallow boosted trees over the statistics of labelled rows give conjunctive rules (the path to each node); a logistic model
with lasso penalty weights them; the rules with weight left are compiled into one Spark column expression.

The model is fitted on at most sample_rows labels (those with the smallest hash of the id), a bound that keeps the fit on the
driver small, and on one of the rows of each labelled id and label (that with the smallest statistics, if an id has several
texts); every row is scored over its whole text. Null and empty texts have all statistics 0. Labels other than 0 and 1 are left
out. If fewer than two classes are labelled, the score is the labelled share of 1, or 1 without labels. Repeated rows get equal
scores. Labels, language, source and ids are no statistics. Other columns pass through, whatever their names, but one named as
the score gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder_is, table, unused, utf8_parts
from .words import parts, word_hashes

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
STATISTICS = ["words", "word_length", "upper", "symbols", "exclaims", "pipes", "digits", "stops", "repeats", "distinct", "short"]
#: Kinds of bytes that are counted: 1 upper case, 2 lower case, 3 digits, 4 symbols, 5 exclamation and question marks, 6 pipes, 7 full stops.
_KIND = np.zeros(256, dtype=np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in "#$%&*+<>=@[\\]^_`{}~/"]] = 4
_KIND[[ord("!"), ord("?")]], _KIND[ord("|")], _KIND[ord(".")] = 5, 6, 7


def statistics_of(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(offsets) - 1
    count = np.bincount(_KIND[data] + 8 * np.repeat(np.arange(n), np.diff(offsets)), minlength=8 * n).reshape(n, 8).astype(float)
    hashes, first, last, rows = word_hashes(offsets, data)
    words = np.diff(rows).astype(float)
    per = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(rows))
    length = (last - first).astype(float)
    out = np.zeros((n, len(STATISTICS)))
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.bincount(owner, length, minlength=n) / per
    out[:, 2] = count[:, 1] / np.maximum(count[:, 1] + count[:, 2], 1)
    for k, kind in ((3, 4), (4, 5), (5, 6), (6, 3), (7, 7)):
        out[:, k] = count[:, kind] / per
    out[:, 8] = np.bincount(owner, same, minlength=n) / per
    out[:, 9] = [len(np.unique(hashes[a:b])) for a, b in zip(rows[:-1], rows[1:], strict=True)] / per
    out[:, 10] = np.bincount(owner, length <= 3, minlength=n) / per
    return out


def with_statistics(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """df with a double column for each of STATISTICS, of the given names."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(s, T.DoubleType()) for s in names)])
    all_names, place = [*df.columns, *names], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8_parts(batch.column(place))
            for a, b in parts(offsets):
                found = statistics_of(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                some = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(found[:, i]) for i in range(found.shape[1]))], names=all_names)

    return df.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, residual: np.ndarray, depth: int, least: int, path: Rule, rules: list[Rule], out: np.ndarray, rows: np.ndarray) -> None:
    """Grow a regression tree on rows; add each node's path to rules and write predictions to out."""
    out[rows] = residual[rows].mean()
    if path:
        rules.append(path)
    if depth == 0 or len(rows) < 2 * least:
        return
    best = (1e-9, -1, 0.0)
    r = residual[rows]
    for j in range(x.shape[1]):
        v = x[rows, j]
        order = np.argsort(v, kind="stable")
        vs, sums = v[order], np.cumsum(r[order])
        k = np.arange(1, len(rows))
        ok = (vs[1:] > vs[:-1]) & (k >= least) & (len(rows) - k >= least)
        gain = np.where(ok, sums[:-1] ** 2 / k + (sums[-1] - sums[:-1]) ** 2 / (len(rows) - k) - sums[-1] ** 2 / len(rows), 0)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (float(gain[i]), j, float((vs[i] + vs[i + 1]) / 2))
    _, j, cut = best
    if j < 0:
        return
    left = x[rows, j] <= cut
    for side, keep in ((False, left), (True, ~left)):
        _tree(x, residual, depth - 1, least, (*path, (j, side, cut)), rules, out, rows[keep])


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8) -> list[Rule]:
    """Distinct paths of boosted trees; a rule's condition (j, True, cut) means statistic j > cut, False means <=."""
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _tree(x, y - p, depth, least, (), rules, step, np.arange(len(y)))
        margin += rate * step / np.maximum((p * (1 - p)).mean(), 0.05)
    return list(dict.fromkeys(rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > cut) if above else (x[:, j] <= cut) for j, above, cut in rule])


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient."""
    z1 = np.hstack([np.ones((len(y), 1)), z])
    rate = 4.0 / max(np.linalg.eigvalsh(z1.T @ z1 / len(y))[-1], 1e-9)
    w = np.zeros(z1.shape[1])
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        new = ahead - rate * (z1.T @ (1 / (1 + np.exp(-np.clip(z1 @ ahead, -30, 30))) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


class RuleModel:
    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleModel:
        if len(y) == 0 or y.min() == y.max():
            p = np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6)
            return cls(float(np.log(p / (1 - p))), [])
        rules = grow_rules(x, y)
        if not rules:
            return cls(float(np.log(y.mean() / (1 - y.mean()))), [])
        intercept, weights = lasso_logistic(np.stack([holds(r, x) for r in rules], axis=1).astype(float), y)
        return cls(intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))

    def column(self, names: list[str]) -> Column:
        """The score as a Spark expression over the columns of with_statistics()."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            tests = [F.col(names[j]) > cut if above else F.col(names[j]) <= cut for j, above, cut in rule]
            total = total + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Learn from at most sample_rows of labels joined to docs; rows of a crc32 remainder 0 modulo 5 are held out."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~remainder_is(key, 5, 0))
    some = usable.select(F.col(key).alias("id"), F.col(label).cast("double").alias("label")).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id")  # sample_rows at most
    rows = with_statistics(texts, "text", STATISTICS).groupBy("id", "label").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    found = rows.select("label", "s.*").toPandas().to_numpy(dtype=float)
    found = found[np.lexsort(found.T)]  # the same model whatever the rows' order
    return RuleModel.fit(found[:, 1:], found[:, 0])


def scored(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """docs with __score."""
    keep = [c for c in docs.columns if c != "__score"]
    names = unused(docs.columns, *STATISTICS)
    return with_statistics(docs.select(*keep), text, names).select(*keep, model.column(names).alias("__score"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    score = F.col("__score").alias("score")
    return scored(docs, model).select("doc_id", remainder_is("doc_id", 5, 0).alias("held_out"), score, (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
