"""Groups of rows in Python by whole batches: rows are dealt and sorted by their keys, and what a task is handed are tables that split no group.

A call per group costs a millisecond however small the group is, so many small groups are worked on together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def dealt_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of equal `keys` in one task, sorted by keys and `order`. The number of tasks is given, as planned ones are too few where small bytes mean much work."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches in tables none of which splits a group of equal `keys` (which aren't null)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.ones(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k)
            last &= pc.equal(column, column[-1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if not cut and held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """The first row of each group of neighbouring rows that are equal in all columns."""
    changed = np.zeros(len(columns[0]), bool)
    changed[:1] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value of a column."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists of numbers."""
    held = column.combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    offsets = held.offsets.to_numpy()
    return held.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of `n` numbers is connected to by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        found = label.copy()
        np.minimum.at(found, label[a], low)
        np.minimum.at(found, label[b], low)
        while not np.array_equal(nearer := found[found], found):
            found = nearer
        if np.array_equal(found, label):
            break
        label = found
    return label
