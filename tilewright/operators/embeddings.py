"""Embeddings per tile, resumable by slide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.paths import embedding_key
from tilewright.functions.plugins import resolve


def pending(slides: DataFrame, done: DataFrame, mode: str = "full") -> DataFrame:
    """Slides whose embedding key isn't among `done` (column key): an anti-join, whose sides both grow with the slides."""
    return slides.withColumn("key", embedding_key(F.col("path"), mode)).join(done.select("key").hint("merge"), "key", "left_anti")


#: Tiles of one task.
TASK_ROWS = 1 << 16


def dealt(samples: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The same tiles in ranges of slide and place, some `task_rows` in each: a large slide is split over tasks, small ones share one.

    What is counted, sampled and moved are names and places, so deal tiles before their pixels are loaded. Small tables use all cores.
    """
    rows = samples.count()
    tasks = max(-(-rows // task_rows), min(rows, samples.sparkSession.sparkContext.defaultParallelism), 1)
    return samples.repartitionByRange(tasks, "slide_name", "y", "x").sortWithinPartitions("slide_name", "y", "x")


def encode(samples: DataFrame, make_encoder: str | Callable[[], Callable[[np.ndarray], np.ndarray]], column: str = "pixels", batch: int = 256, transform: str | Callable[[np.ndarray], np.ndarray] | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """slide_name, x, y, embedding. The encoder is made once per task and gets batches of rows as a float32 matrix, after `transform` if there is one.
    Pixels and embeddings cross as whole columns, with no object for a row.

    Both may be given by dotted name. `profile` is what the stage asks for, see `resources.stage_profile`.
    """
    make_encoder = resolve(make_encoder) if isinstance(make_encoder, str) else make_encoder
    transform = resolve(transform) if isinstance(transform, str) else transform

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                rows = matrix(part.column(3))
                out = encoder(transform(rows) if transform else rows)
                found = pa.array([v.astype(np.float32) for v in out], pa.list_(pa.float32())) if not isinstance(out, np.ndarray) or out.ndim != 2 else lists(out.astype(np.float32))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], found], names=["slide_name", "x", "y", "embedding"])

    return samples.select("slide_name", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), column).mapInArrow(run, "slide_name string, x int, y int, embedding array<float>", profile=profile)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a float32 matrix."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    if column.null_count or column.flatten().null_count:
        return np.stack([np.asarray(v, np.float32) for v in column.to_pylist()])
    if (lengths != lengths[:1]).any():
        raise ValueError("all tiles have equally many pixels")
    return column.flatten().to_numpy().astype(np.float32).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32)), pa.array(np.ascontiguousarray(rows).ravel()))


def projection_encoder(size: int = 16) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A stand-in for a trained model: a fixed projection, whose weight of input i and output j is (7 i + 13 j) mod 11 - 5."""

    def make():
        def encode_rows(x: np.ndarray) -> np.ndarray:
            return x @ ((7 * np.arange(x.shape[1])[:, None] + 13 * np.arange(size)) % 11 - 5).astype(np.float32)

        return encode_rows

    return make


def small_projection() -> Callable[[np.ndarray], np.ndarray]:
    """The stand-in of 16 outputs, for jobs that name their encoder."""
    return projection_encoder()()
