"""A training corpus from the documents table: five stages, each a table that the next one reads.

1. quality: documents that the rule ensemble scores below its threshold go.
2. line_dedup: lines on several sites, short ones too, go, but for their first occurrence; n_chars follows the text.
3. near_dedup: one document of each group of near-duplicates stays (five-word shingles, similarity 0.8).
4. mixing: all rows, in the order in which the source schedule takes them.
5. tokenise: position in that schedule, ids, their number and digests; the text that the ids decode to is checked by its digest.
   Tables keep no order of rows, so the position is worked out again from the same rows; sorted by it, they are the mix.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import DOCUMENT_COLUMNS, cut, table
from sitelens.llm.line_dedup import dedup_lines
from sitelens.llm.minhash_dedup import near_duplicates
from sitelens.llm.mixing import schedule
from sitelens.llm.piece_codec import encode
from sitelens.llm.quality import THRESHOLD, fit, scored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).where(F.col("__score") >= THRESHOLD).select(*DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = near_duplicates(docs, shingle=5).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return schedule(docs).orderBy("__position").select(*DOCUMENT_COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = schedule(docs).withColumnRenamed("__position", "position")
    return encode(placed, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source", "position"], digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("tokenise", tokenise),
]

#: The first stage's model and the third stage's exact groups have no SQL form; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
