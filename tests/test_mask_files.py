"""Mask files: what one task sorts is bounded by the bytes of its lines."""

from pyspark.sql import functions as F

from tilewright.sources import schemas, sinks


def test_tasks_follow_the_bytes_of_lines(spark, tmp_path):
    n, wide = 2000, 300
    line = F.array_repeat(F.lit(255).cast("smallint"), wide)
    lines = spark.range(n).select(F.when(F.col("id") % 2 == 0, "/m/a.tiff").otherwise("/m/b.tiff").alias("mask_path"), F.expr("cast(999 - id div 2 as int)").alias("y"), F.lit(1.0).alias("mpp_x"), F.lit(2.0).alias("mpp_y"), line.alias("row"))
    odd = spark.createDataFrame([(None, 0, 1.0, 2.0, [1]), ("/m/c.tiff", None, 1.0, 2.0, None), ("/m/c.tiff", 5, 1.0, 2.0, [])], schemas.MASK_ROWS)
    rows = lines.union(odd)
    sinks.write_masks(rows, str(tmp_path / "m"), task_bytes=n * wide * 2 // 30)
    found = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.collect()))
    files = found.select(F.input_file_name().alias("file"), "mask_path", "y").collect()
    by_file = {}
    for r in files:
        by_file.setdefault(r.file, []).append((r.mask_path or "", -1 if r.y is None else r.y))
    assert len(by_file) > 4  # one partition per stretch at most: two masks of four stretches each
    assert all(held == sorted(held) for held in by_file.values())
    homes = {}
    for file, held in by_file.items():
        for path, y in held:
            homes.setdefault((path, y // sinks.STRETCH), set()).add(file)
    assert all(len(h) == 1 for h in homes.values())


def test_no_lines(spark, tmp_path):
    sinks.write_masks(spark.createDataFrame([], schemas.MASK_ROWS), str(tmp_path / "m"))
    assert spark.read.schema(schemas.MASK_ROWS).parquet(str(tmp_path / "m")).count() == 0
