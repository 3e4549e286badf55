"""What the operators on embeddings share: rows of integers and their arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that isn't null and has no null and no non-finite component."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """Each component times the factor, rounded down."""
    return F.transform(vector.cast("array<double>"), lambda v: F.floor(v * factor).cast("long"))


def extent(rows: DataFrame, most: int) -> tuple[int, int, int]:
    """(rows, longest vector, largest component by size) of ``rows`` (q); an error beyond ``most``."""
    size = F.greatest(F.abs(F.coalesce(F.array_max("q"), F.lit(0))), F.abs(F.coalesce(F.array_min("q"), F.lit(0))))
    n, width, largest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if largest > most:
        raise ValueError(f"a component of {largest} is beyond {most}, to which whole products are exact")
    return n, width, largest


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers; vectors shorter than ``width`` end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
