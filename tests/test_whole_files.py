"""Files of small masks made by one call: the same bytes as those put together tile by tile."""

import os
import random

import pytest

from tilewright.operators import pyramids

ROWS = "mask_path string, y int, mpp_x double, mpp_y double, row array<smallint>"


def test_bytes_equal_those_of_tiles(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    line = lambda n: [rng.choice([0, 0, 7, 255]) for _ in range(n)]
    rows = [(f"/m/{k}.tiff", y, 0.5, None if k == 3 else 0.25, line(w)) for k, (h, w) in enumerate([(3, 7), (16, 16), (9, 70), (65, 17), (40, 33), (33, 130)]) for y in range(h) if rng.random() < 0.9 or y == h - 1]
    rows += [("/m/ragged.tiff", y, 1.0, 1.0, line(rng.choice([1, 20, 40]))) for y in (0, 1, 1, 1, 5, 37, 37)] + rows[:4]
    table = spark.createDataFrame(rows, ROWS).repartition(3)
    read = lambda name: {f: open(tmp_path / name / f, "rb").read() for f in os.listdir(tmp_path / name)}  # noqa: E731, SIM115
    for name, whole in (("tiles", 0), ("some", 40), ("whole", 1024)):
        monkeypatch.setattr(pyramids, "WHOLE", whole)
        assert pyramids.write_pyramids(table, str(tmp_path / name), side=16) == 5
    assert len(read("whole")) == 7 and read("tiles") == read("whole") == read("some")


@pytest.mark.parametrize("largest,levels", [(1, 1), (16, 1), (17, 2), (32, 2), (33, 3)])
def test_number_of_levels(spark, tmp_path, largest, levels):
    table = spark.createDataFrame([("m.tiff", 0, 1.0, 1.0, [1] * largest)], ROWS)
    assert pyramids.write_pyramids(table, str(tmp_path / "n"), side=16) == levels
