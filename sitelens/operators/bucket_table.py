"""A table in hash buckets whose changes rewrite the buckets they touch and no others.

path/data/<version>/bucket=<b> holds rows, path/versions/<version> a manifest: for each bucket the folder that holds it. A change
reads the buckets of the incoming keys, writes them anew under the next version, and at last the manifest. Until that is whole
(it has Spark's _SUCCESS), readers have the version before; what a broken change has left is never read, and vacuum() deletes it.
Two changes at once would write one version: the second one's manifest fails. The number of buckets is set when a table is made,
and is what the driver holds of a manifest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import upserted

MANIFEST = "bucket int, folder string, keys array<string>, buckets int, columns string"


class BucketTable:
    """A table at a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], *, buckets: int = 64) -> BucketTable:
        """A new table of df's rows, of which each key has one."""
        table = cls(df.sparkSession, path)
        if table.versions():
            raise ValueError(f"{path} holds a table already")
        table._write(df, 0, {}, keys, buckets)
        return table

    def _files(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, files = self._files()
        at = path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []

    def versions(self) -> list[int]:
        """Versions whose manifest is whole."""
        path, files = self._files()
        return [int(v) for v in self._names("versions") if files.exists(path(f"{self.path}/versions/{v}/_SUCCESS"))]

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, str], list[str], int, T.StructType]:
        version = max(self.versions()) if version is None else version
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/versions/{version:012d}").collect()  # a row for each bucket
        folders = {r["bucket"]: r["folder"] for r in rows if r["folder"] is not None}
        return version, folders, list(rows[0]["keys"]), rows[0]["buckets"], T.StructType.fromJson(json.loads(rows[0]["columns"]))

    def _read(self, folders: list[str], columns: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, or of the last one."""
        _, folders, _, _, columns = self._manifest(version)
        return self._read(sorted(folders.values()), columns)

    def find(self, **key) -> DataFrame:
        """The row of one key: its bucket is all that is read."""
        _, folders, keys, buckets, columns = self._manifest()
        if sorted(key) != sorted(keys):
            raise ValueError(f"keys are {keys}")
        values = [F.lit(key[k]).cast(columns[k].dataType) for k in keys]
        bucket = self.spark.range(1).select(_bucket(values, buckets)).first()[0]
        rows = self._read([folders[bucket]] if bucket in folders else [], columns)
        for k in keys:
            rows = rows.where(F.col(k).eqNullSafe(F.lit(key[k]).cast(columns[k].dataType)))
        return rows

    def touched(self, incoming: DataFrame) -> list[int]:
        """Buckets of the keys of some rows."""
        _, _, keys, buckets, _ = self._manifest()
        return sorted(r[0] for r in incoming.select(_bucket([F.col(k) for k in keys], buckets)).distinct().collect())  # as many as there are buckets

    def upsert(self, incoming: DataFrame, newest: Column) -> int:
        """Put rows in place of those with their keys, of several the newest; the version that holds them."""
        version, folders, keys, buckets, columns = self._manifest()
        some = self.touched(incoming)
        if not some:
            return version
        before = self._read([folders[b] for b in some if b in folders], columns)
        self._write(upserted(before, incoming, keys, newest).select(*columns.names), version + 1, {b: f for b, f in folders.items() if b not in some}, keys, buckets)
        return version + 1

    def delete(self, gone: DataFrame) -> int:
        """Take out the rows with the keys of some rows; the version without them."""
        version, folders, keys, buckets, columns = self._manifest()
        some = [b for b in self.touched(gone) if b in folders]
        if not some:
            return version
        rest = self._read([folders[b] for b in some], columns).join(gone.select(*keys).distinct(), keys, "left_anti").select(*columns.names)
        self._write(rest, version + 1, {b: f for b, f in folders.items() if b not in some}, keys, buckets)
        return version + 1

    def _write(self, df: DataFrame, version: int, kept: dict[int, str], keys: list[str], buckets: int) -> None:
        name = f"{version:012d}"
        own = df.withColumn("bucket", _bucket([F.col(k) for k in keys], buckets))
        own.repartition(buckets, "bucket").sortWithinPartitions("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        new = {int(f.split("=")[1]): f"{name}/{f}" for f in self._names(f"data/{name}") if f.startswith("bucket=")}
        rows = [(b, f, keys, buckets, df.schema.json()) for b, f in sorted((kept | new).items())] or [(None, None, keys, buckets, df.schema.json())]
        self._commit(self.spark.createDataFrame(rows, MANIFEST).coalesce(1), name)

    def _commit(self, manifest: DataFrame, name: str) -> None:
        path, files = self._files()
        at = path(f"{self.path}/versions/{name}")
        if files.exists(at) and not files.exists(path(f"{self.path}/versions/{name}/_SUCCESS")):
            files.delete(at, True)  # of a change that broke off
        manifest.write.mode("error").parquet(f"{self.path}/versions/{name}")

    def vacuum(self, keep: int = 1) -> None:
        """Delete the versions before the last ones, and all rows that none of these has."""
        path, files = self._files()
        last = sorted(self.versions())[-keep:]
        used = {f for v in last for f in self._manifest(v)[1].values()}
        for v in self._names("versions"):
            if int(v) < last[0]:
                files.delete(path(f"{self.path}/versions/{v}"), True)
        for v in self._names("data"):
            for b in self._names(f"data/{v}"):
                if b.startswith("bucket=") and f"{v}/{b}" not in used:
                    files.delete(path(f"{self.path}/data/{v}/{b}"), True)


def _bucket(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
