"""Vectors of whole numbers for the operators on embeddings: selection, scaling, matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers up to this size are exact as doubles.
EXACT = 2.0**53
LONGEST = 2**63 - 1


def complete(v: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def floored(v: Column, scale: int) -> Column:
    """floor(scale * c) of each component as a double; products beyond the exact doubles, which are
    whole anyway, are cut to the largest double."""

    def whole(c: Column) -> Column:
        y = F.greatest(F.least(c.cast("double") * scale, F.lit(1.7e308)), F.lit(-1.7e308))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(v, whole)


def matrix(column: pa.Array | pa.ChunkedArray, width: int, fill: float = 0.0) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors are filled up."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.full((len(n), width), fill)
    out[np.arange(width) < n[:, None]] = flat
    return out
