"""Helpers that the training-data operators share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master (tests) a folder of this machine if unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="sitelens-")
    return _OWN_DIR[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitelens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote; nothing that is still to run may read them."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(conf).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores in front as keep it apart from the columns (case doesn't part names in Spark)."""
    taken = {c.lower() for c in columns}
    return [next(n for k in itertools.count() if (n := "_" * k + name).lower() not in taken) for name in names]


def remainder_is(key: str | Column, modulus: int, value: int) -> Column:
    """crc32(key as text) mod modulus = value; a null key counts as not equal."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == value, F.lit(False))


def utf8_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(large)
    if column.null_count:
        column = column.fill_null(b"" if large == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    first = column.offset
    offsets = np.frombuffer(offsets, dtype=np.int64)[first : first + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of batches that are sorted by keys (integers), with the groups' offsets."""
    held: pa.Table | None = None

    def edges(rows: pa.Table) -> np.ndarray:
        values = [rows.column(k).to_numpy() for k in keys]
        return np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        starts = edges(rows)
        if len(starts):
            yield rows.slice(0, int(starts[-1])), np.concatenate([[0], starts])
            rows = rows.slice(int(starts[-1]))
        held = rows if rows.num_rows else None
    if held is not None:
        yield held, np.array([0, held.num_rows])
