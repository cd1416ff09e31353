"""Rows of numbers for the vector operators: what is kept, and whole numbers in place of components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole components stay below this, so that sums of some hundred products of two of them fit 64 bits.
MOST = 1 << 28


def usable(vector: Column) -> Column:
    """False for a null or empty vector, and for one with a null, NaN or infinite component."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(F.transform(vector, lambda x: x.cast("double")), number), F.lit(False))


def usable_rows(df: DataFrame, *more: str, vector: str = "embedding") -> DataFrame:
    """vec_id, the named columns and `vector`, of the rows whose vector is usable."""
    return df.select(F.col("vec_id").cast("bigint").alias("vec_id"), *more, F.col(vector).alias("vector")).where(usable(F.col("vector")))


def matrix(column: pa.Array, scale: int, dims: int) -> np.ndarray:
    """floor(scale * component) of all rows of a list column; vectors of a length other than `dims` or with components beyond MOST are an error."""
    lengths = np.asarray(column.value_lengths())
    if len(lengths) and (lengths != dims).any():
        raise ValueError(f"vectors of {dims} components are asked for; there is one of {int(lengths[lengths != dims][0])}")
    x = np.floor(scale * np.asarray(column.flatten(), np.float64)).reshape(len(lengths), dims)
    if x.size and np.abs(x).max() >= MOST:
        raise ValueError(f"a component beyond {MOST} after scaling by {scale}")
    return x.astype(np.int64)
