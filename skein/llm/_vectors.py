"""Vectors as tables: entries made whole numbers, so that sums and products are exact, and arrays of them inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers up to this are exact as doubles.
EXACT = 2**53


def is_whole(vec: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return vec.isNotNull() & F.coalesce(F.forall(vec, finite), F.lit(False))


def whole_entries(vec: Column, scale: int) -> Column:
    """floor(scale * c) of each entry c, as longs."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def largest(x: Column) -> Column:
    """The largest size of an entry."""
    return F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0).cast("long"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of longs; what a short list lacks is 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
