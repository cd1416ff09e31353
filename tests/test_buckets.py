"""Buckets of many rows are written by several tasks, and still linked without moving a row."""

from pyspark.sql import functions as F

from tilewright.operators import dataset
from tilewright.sources import sinks


def test_a_bucket_is_written_in_bounded_parts(spark, tmp_path):
    slides = spark.range(40).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.col("id").cast("string").alias("path"), *[F.lit(n).alias(c) for c, n in (("level", 0), ("tile_extent_x", 64), ("tile_extent_y", 64))])
    tiles = slides.select(F.col("id").alias("slide_id"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("tile_x"), F.lit(0).alias("tile_y"))
    s, t = sinks.write_buckets(slides, tiles, str(tmp_path), "parts", 4, task_rows=250)
    files = [f.rsplit("_", 1)[1][:5] for f in t.inputFiles()]
    assert len(files) > 8 and set(files) == {f"{k:05d}" for k in range(4)}
    rows = t.groupBy(F.input_file_name().alias("f")).count().collect()
    assert max(r["count"] for r in rows) < 4000 / 4
    linked = dataset.link_tiles(s, t)
    assert "Exchange" not in linked._jdf.queryExecution().executedPlan().toString()
    assert linked.count() == 4000 and linked.select("path", "x").distinct().count() == 4000
