"""Tissue masks: a model is called once per slide, and lines come out whole and in order."""

import uuid

from pyspark.sql import functions as F

from tilewright.plans import jobs


def test_one_call_per_slide(spark, tmp_path):
    calls, n = tmp_path / "calls", 30
    calls.mkdir()
    files = spark.range(n).select(F.concat(F.lit("/s/"), F.col("id").cast("string"), F.lit(".mrxs")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    levels = files.select("path", F.lit(1).alias("level"), F.lit(0.5).alias("mpp_x"), F.lit(0.25).alias("mpp_y")).union(files.select("path", F.lit(0), F.lit(9.0), F.lit(9.0)))

    def segment(content, mpp):
        (calls / f"{content.decode()}-{uuid.uuid4().hex}").touch()
        return [[255, 0, y] if mpp == 0.375 else [] for y in range(int(content) % 4 + 1)]

    jobs.tissue_masks_job(files, levels, 1, segment, str(tmp_path / "m"))
    assert sorted(int(f.name.split("-")[0]) for f in calls.iterdir()) == list(range(n))
    found = spark.read.parquet(str(tmp_path / "m"))
    assert sorted((r.mask_path, r.y, r.mpp_x, r.mpp_y, r.row) for r in found.collect()) == sorted((f"{k}.tiff", y, 0.5, 0.25, [255, 0, y]) for k in range(n) for y in range(k % 4 + 1))


def test_lines_in_small_frames_and_a_slide_without_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "CELLS", 5)
    files = spark.createDataFrame([("/s/a.mrxs", bytearray(b"abc")), ("/s/b.mrxs", bytearray(b"")), ("/s/c.mrxs", bytearray(b"d" * 9))], "path string, content binary")
    levels = files.select("path", F.lit(0).alias("level"), F.lit(1.0).alias("mpp_x"), F.lit(1.0).alias("mpp_y"))
    jobs.tissue_masks_job(files, levels, 0, lambda c, mpp: [[v % 256, 0] for v in c], str(tmp_path / "m"))
    assert sorted((r.mask_path, r.y, r.row) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("a.tiff", k, [97 + k, 0]) for k in range(3)] + [("c.tiff", k, [100, 0]) for k in range(9)]
