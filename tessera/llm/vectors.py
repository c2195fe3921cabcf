"""What the two operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy().astype("f8"), offsets


def by_length(column: pa.Array):
    """(row numbers, matrix) for each vector length."""
    values, offsets = arrays(column)
    size = np.diff(offsets)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, values[offsets[at][:, None] + np.arange(n)]


def pack(column: pa.Array, kind: str) -> pa.Array:
    """A list column without nulls as the bytes of its numbers."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def by_packed(column: pa.Array, kind: str, to: str = "f8"):
    """(row numbers, matrix) for each vector length of a column made by pack."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data, size = np.frombuffer(data, np.uint8), np.diff(offsets)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        rows = data[offsets[0] : offsets[-1]].reshape(-1, n) if len(at) == len(size) else data[offsets[at][:, None] + np.arange(n)]
        yield at, rows.view(kind).astype(to)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first so that no square overflows or vanishes."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def valid(table: DataFrame, ident: str, vector: str) -> DataFrame:
    return table.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
