"""Search for parts of words in texts by trigram postings, with exact verification.

path/postings holds a row for each trigram and id, in buckets by hash of the trigram, sorted by it; path/counts how many ids each
trigram has; path/texts the texts themselves, in buckets by hash of the id. A search reads the counts of the term's trigrams, the
postings of the rarest few, and of the texts the buckets of the ids that have them all. What is found is what contains() finds, as
each candidate's text is looked at. Terms of one or two characters are looked up in the trigrams that hold them; texts that short
are postings of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
ABOUT = "columns array<string>, kind string"
#: Trigrams of a term that are looked up, the rarest ones.
RAREST = 4


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text, or the text itself if it is shorter (none if it is empty)."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(n >= 3, F.array_distinct(grams)).when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def _bucket(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """An index at a path of any file system that Spark reaches; built once, read by any number of sessions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.schema(ABOUT).parquet(f"{self.path}/about").first()
        self.columns, self.kind = list(about["columns"]), about["kind"]

    @classmethod
    def build(cls, df: DataFrame, path: str, columns: list[str], *, key: str = "id") -> TextIndex:
        """Index the lower-case texts of some columns of df; key is unique."""
        path = path.rstrip("/")
        low = df.select(F.col(key).alias("id"), *(F.lower(c).alias(c) for c in columns))
        texts = low.withColumn("bucket", _bucket("id"))
        texts.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{path}/texts")
        grams = low.select("id", F.explode(F.array(*(F.col(c) for c in columns))).alias("text")).where(F.col("text").isNotNull())
        posted = grams.select("id", F.explode(trigrams(F.col("text"))).alias("gram")).distinct().withColumn("bucket", _bucket("gram"))
        # A trigram that nearly every text has is spread over files by its ids.
        posted.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
        df.sparkSession.createDataFrame([(columns, dict(low.dtypes)["id"])], ABOUT).write.parquet(f"{path}/about")
        index = cls(df.sparkSession, path)
        index._posted().groupBy("bucket", "gram").agg(F.count("*").alias("n")).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
        return index

    def _posted(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.kind}, gram string, bucket int").parquet(f"{self.path}/postings")

    def _texts(self) -> DataFrame:
        return self.spark.read.schema(", ".join([f"id {self.kind}", *(f"`{c}` string" for c in self.columns), "bucket int"])).parquet(f"{self.path}/texts")

    def candidates(self, term: str) -> DataFrame:
        """id of the texts that have the rarest trigrams of a term."""
        low = term.lower()
        if len(low) < 3:
            return self._posted().where(F.col("gram").contains(low)).select("id").distinct()
        grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
        where = self.spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _bucket("gram").alias("bucket")).collect()  # the term's
        counts = self.spark.read.schema("gram string, n long, bucket int").parquet(f"{self.path}/counts").where(F.col("bucket").isin(sorted({r["bucket"] for r in where})) & F.col("gram").isin(grams))
        known = sorted((r["n"], r["gram"]) for r in counts.select("gram", "n").collect())  # at most one for each of the term's
        if len(known) < len(grams):
            return self._posted().where("false").select("id")
        rare = [g for _, g in known[:RAREST]]
        own = self._posted().where(F.col("bucket").isin(sorted({r["bucket"] for r in where if r["gram"] in rare})) & F.col("gram").isin(rare))
        return own.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("id")

    def search(self, term: str) -> DataFrame:
        """The rows (id and lower-case texts) of which one text holds the term, whatever its case; an empty term finds all that have a text."""
        texts = self._texts()
        holds = F.lit(False)
        for c in self.columns:
            holds = holds | F.coalesce(F.col(c).contains(term.lower()), F.lit(False))
        if not term:
            return texts.where(holds).drop("bucket")
        found = self.candidates(term)
        some = [r[0] for r in found.select(_bucket("id").alias("b")).distinct().collect()]  # as many as there are buckets
        return texts.where(F.col("bucket").isin(some) & holds).join(found, "id", "left_semi").drop("bucket")


def find_page(index: TextIndex, url: str) -> DataFrame:
    """id and texts of the page with the URL, or else of the first whose URL (normalized_url) holds it, whatever the case."""
    at = F.col("normalized_url")
    hit = at == url.lower()
    return index.search(url).where(at.contains(url.lower())).orderBy(hit.desc(), "id").limit(1)
