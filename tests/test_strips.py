"""Words and sums of columns by compiled expressions: wide and ragged lines against counting, and no lambda function over pixels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions.geometry import Box
from tilewright.operators import masks
from tilewright.plans import fixtures

ROWS = "mask_path string, y int, mpp_x double, mpp_y double, row array<smallint>"


def test_wide_lines_against_counting(spark):
    """Lines over several blocks, some of which end early, in regions over several bands."""
    rng = random.Random(7)
    lines = {y: [rng.choice([0, 0, 255, 7]) for _ in range(rng.choice([511, 512, 513, 1100, 1100, 1300]))] for y in range(140) if y == 0 or rng.random() < 0.95}
    table = spark.createDataFrame([("m", y, 2.0, 1.0, row) for y, row in lines.items()], ROWS)
    places = [(rng.randrange(0, 2700), rng.randrange(0, 120)) for _ in range(60)]
    tiles = spark.createDataFrame([("m", x, y, 1.0, 1.0) for x, y in places], "mask string, tile_x int, tile_y int, mpp_x double, mpp_y double")
    for value in ("0", "255"):
        for r in masks.add_overlaps(tiles, table, [masks.Overlap("o", "mask", Box(0, 0, 150, 90), value)], "documented").collect():
            x0, x1 = math.floor(r.tile_x / 2), math.ceil((r.tile_x + 150) / 2)
            seen = [v for y in range(r.tile_y, r.tile_y + 90) for x, v in enumerate(lines.get(y, ())) if x0 <= x < x1]
            assert r.o == (1 - sum(v == int(value) for v in seen) / len(seen) if seen else 0.0)


def test_too_many_lines_raise(spark):
    table = spark.range(1 << 15).select(F.lit("m").alias("mask_path"), F.col("id").cast("int").alias("y"), F.lit(1.0).alias("mpp_x"), F.lit(1.0).alias("mpp_y"), F.array(F.lit(0).cast("smallint")).alias("row"))
    tiles = spark.createDataFrame([("m", 0, 0, 1.0, 1.0)], "mask string, tile_x int, tile_y int, mpp_x double, mpp_y double")
    score = lambda tall: masks.add_overlaps(tiles, table, [masks.Overlap("o", "mask", Box(0, 0, 1, tall), "255")], "documented").first().o
    assert score((1 << 15) - 1) == 1.0
    with pytest.raises(Exception, match="too many lines"):
        score(1 << 15)


def test_pixels_meet_no_lambda_function(spark):
    """The words of a line were put together by a lambda function over its pixels, which isn't compiled: 195 s of tasks on sf0.1, of which these and the lines themselves were most."""
    rows = spark.createDataFrame([("m", 0, 1.0, 1.0, [0, 255, 0] * 30)], ROWS)
    blocks = masks.mask_blocks(rows, ["0", "255"])
    assert "aggregate(" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    line = blocks.first()["lines"][0]
    for v in (0, 255):
        assert [w & (1 << 64) - 1 for w in line[f"v{v}"]] == [sum(1 << k for k in range(64) if at + k < 90 and [0, 255, 0][(at + k) % 3] == v) for at in (0, 64)]


def test_lines_wider_than_usual_are_whole(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    get = lambda: sorted((r.mask_path, r.y, tuple(r.row)) for r in fixtures.masks(spark, sf, ("blur",)).where("crc32(mask_path) % 16 = 0").collect())
    usual = get()
    monkeypatch.setattr(fixtures, "USUAL", 10)
    assert get() == usual and any(len(r[2]) > 110 for r in usual) and any(len(r[2]) <= 110 for r in usual)
