"""Spelling variants by anagram hashing: words one letter apart, and the form that a word is a variant of. DataFrame functions only.

The key of a word is the sum of the fourth powers of its code points: anagrams share it, and one added, removed or exchanged letter
changes it by one letter's value, or by the difference of two. Each word gives its key less the value of each of its letters; two
words of equal length that share such a remainder differ by one exchange (or are anagrams), and a remainder that is another word's
key by one removed letter. So the join is on equal numbers, and needs no list of all differences. Fourth powers of the letters taken
here have distinct differences, and the sum stays below 2^63 for any string that Spark can hold.

As letter order counts, the join also asks that half of the shorter word agrees, its front or its back: whatever the place of the one
letter, one of these does. So large classes of anagrams don't meet as a whole. What is left is verified by edit distance.

A word's form is the near word of largest count (ties: the smallest in code-point order) if that is at least `ratio` times its own;
roots follow forms by pointer doubling: counts grow by the ratio each time, so a few rounds do. Words are counted before anything is
shuffled. Null texts have no words; words of any length are handled; repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, table

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
#: What a word is: a maximal run of these. Fixed values.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A-Z as a-z, other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(docs: DataFrame, *, text: str = "text", min_length: int = MIN_LENGTH, keep: list[str] | None = None) -> DataFrame:
    """keep's columns and word, a row for each maximal run of at least min_length letters, A-Z lower-cased."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    return docs.select(*(keep or []), F.explode(runs).alias("word")).withColumn("word", lower_ascii(F.col("word")))


def _value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code


def _half(word: Column, left: Column, side: Column) -> Column:
    """The front (side 0) or the back (1) half of a word, for so many letters that are left of it."""
    half = F.floor(left / 2).cast("int")
    return F.when(side == 0, F.substring(word, F.lit(1), half)).when(half > 0, F.substring(word, F.length(word) - half + 1, half)).otherwise("")


def _entries(counted: DataFrame) -> DataFrame:
    """word, n, whole, met: two entries (halves) of each word as a whole, and for each of its letters of the word less that letter.

    met is a hash of the remaining key, its length, and the half; its last bit is the side. It is all of an entry that is shuffled
    beside word and count: what it stands for is looked at again when words have met.
    """
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    key = F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: s + _value(c))
    keyed = counted.select("word", "n", letters.alias("letters")).select("word", "n", "letters", key.alias("key"), F.size("letters").alias("length"))
    less = F.transform(F.array_distinct("letters"), lambda c: F.struct((F.col("key") - _value(c)).alias("key"), (F.col("length") - 1).alias("left"), F.lit(False).alias("whole")))
    every = keyed.select("word", "n", F.explode(F.concat(F.array(F.struct("key", F.col("length").alias("left"), F.lit(True).alias("whole"))), less)).alias("e")).select("word", "n", "e.*")
    sides = every.select("word", "n", "key", "left", "whole", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    met = F.shiftleft(F.xxhash64("key", "left", _half(F.col("word"), F.col("left"), F.col("side"))), 1).bitwiseOR(F.col("side").cast("long"))
    return sides.select("word", "n", "whole", met.alias("met"))


def near_pairs(counted: DataFrame) -> DataFrame:
    """word, n, near, near_n: ordered pairs of words of the table (word, n; each word once) that differ by exactly one code point."""
    every = _entries(counted)
    right = every.select("met", F.col("word").alias("near"), F.col("n").alias("near_n"), "whole")
    met = every.where(~F.col("whole")).drop("whole").join(right, "met").where(F.col("whole") | (F.col("word") < F.col("near")))
    left, side = F.length("word") - 1, F.col("met").bitwiseAND(1)
    as_long = F.length("near") == F.length("word") - F.when(F.col("whole"), 1).otherwise(0)
    half = lambda s: _half(F.col("word"), left, s) == _half(F.col("near"), left, s)
    once = F.when(side == 0, half(F.lit(0))).otherwise(half(F.lit(1)) & ~half(F.lit(0)))  # what agrees in front has met there
    pairs = met.where(as_long & once & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n")
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def variants(counted: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of a table (word, n; each word once)."""
    if ratio < 2:
        raise ValueError("counts must grow from a word to its form")
    counted = cut(counted.select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("own"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("own")
    near = cut(near.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "near")
    roots = _roots(near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    out = counted.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root, which is no word of the table any more: each round doubles how far a word looks."""
    now = cut(forms.select("word", "root", F.lit(True).alias("moved")), "forms")
    while not now.where("moved").isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, now = now, cut(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        discard(last)
    return now.select("word", "root")


def misspelt(key: Column, word: Column) -> Column:
    """The word less its code point h % length where 31 divides h, the crc32 of `<key>:<word>`; a null key changes nothing."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    every = words(docs, keep=["doc_id"]).select(misspelt(F.col("doc_id"), F.col("word")).alias("word"))
    counted = every.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)
    return variants(counted)
