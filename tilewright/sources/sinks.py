"""Sinks: executors write, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_dataset(slides: DataFrame, tiles: DataFrame, root: str, name: str, rows_per_file: int = 0) -> dict[str, int]:
    """Writes <root>/<name>/slides and /tiles, in files of at most `rows_per_file` rows if it is given; returns both row counts, observed while writing."""
    counts = {}
    for part, df in (("slides", slides), ("tiles", tiles)):
        seen = Observation(part)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{root}/{name}/{part}")
        counts[part] = seen.get["n"]
    return counts


#: Rows that one task sorts for its bucket.
TASK_ROWS = 1 << 20


def write_buckets(slides: DataFrame, tiles: DataFrame, root: str, name: str, buckets: int, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """A pair as tables `<name>_slides` and `<name>_tiles` below `root`, both in `buckets` buckets of the slide id: linking them, or grouping tiles by slide, moves no row.

    A bucket is dealt by slide to as many tasks (and files) as keep some `task_rows` in each: a multiple of `buckets`, so a task meets one bucket alone.
    """
    for part, df, key in (("slides", slides, "id"), ("tiles", tiles, "slide_id")):
        tasks = buckets * max(1, -(-df.count() // (buckets * task_rows)))
        df.repartition(tasks, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{name}/{part}").saveAsTable(f"{name}_{part}")
    return slides.sparkSession.table(f"{name}_slides"), slides.sparkSession.table(f"{name}_tiles")


def write_embeddings(embeddings: DataFrame, root: str, key: str = "slide_name") -> None:
    """One folder per slide; only slides that are written are replaced, and only whole tasks are committed."""
    out = embeddings.select(key, F.col("x").cast("int"), F.col("y").cast("int"), F.col("embedding").cast("array<float>"))
    out.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(root)


#: Bytes of mask rows that one task sorts, and neighbouring lines of a mask that stay together.
TASK_BYTES, STRETCH = 1 << 26, 256


def write_masks(rows: DataFrame, root: str, task_bytes: int = TASK_BYTES) -> None:
    """Raster rows, near each other by mask and line: masks, in stretches of STRETCH lines, are dealt to as many tasks (and files) as keep some `task_bytes` in each.

    Bytes are those of the pixels as they are sorted. Those that are moved tell little, as masks compress well.
    """
    held = rows.agg(F.sum(F.coalesce(F.size("row"), F.lit(0)).cast("bigint") * 2 + 128)).first()[0] or 0
    tasks = max(-(-held // task_bytes), rows.sparkSession.sparkContext.defaultParallelism)
    rows.repartition(tasks, "mask_path", F.floor(F.col("y") / STRETCH)).sortWithinPartitions("mask_path", "y").write.mode("overwrite").parquet(root)
