"""Vectors as flat arrays: decoding of array columns, and which rows are usable."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vector: str) -> Column:
    """Not null, not empty, without null or non-finite components, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def as_matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """float64 matrix of a binary column of float64 vectors."""
    values = b"".join(column.to_pylist())
    return np.frombuffer(values, dtype=np.float64).reshape(-1, dimension)


def balanced(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between a half and one: exact, and products stay finite."""
    if not len(x):
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def packed(df: DataFrame, vector: str, into: str) -> DataFrame:
    """df with usable vectors as float64 bytes in a binary column into, in place of the array column."""
    keep = [c for c in df.columns if c != vector]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(into, T.BinaryType())])
    names = [*keep, into]

    def run(batches):
        for batch in batches:
            lists = batch.column(len(keep))
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).tobytes()
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]) * 8
            cells = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], cells], names=names)

    return df.select(*keep, vector).mapInArrow(run, schema)
