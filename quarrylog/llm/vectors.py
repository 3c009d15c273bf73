"""Vectors as matrices: which rows take part, and the rows of an Arrow column as a numpy matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str = "embedding") -> Column:
    """True for vectors that are not null and hold neither nulls nor non-finite components."""
    def good(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, good), F.lit(False))


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """The column's vectors in double precision. Shorter ones are filled up with zeros, to the longest or to dims."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    most = max(dims or 0, int(length.max()) if len(length) else 0)
    if len(length) and (length == most).all():
        return flat.reshape(len(length), most)
    out = np.zeros((len(length), most))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out
