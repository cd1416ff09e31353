"""Pixels and embeddings cross as whole columns, and names are made for each slide, not for each tile."""

import numpy as np
import pyarrow as pa
import pytest

from tilewright.operators import dataset, embeddings

SLIDES = "path string, id string, level int, tile_extent_x int, tile_extent_y int"


def test_lists_and_matrices():
    rows = np.arange(12, dtype=np.float32).reshape(4, 3)
    assert embeddings.lists(rows).to_pylist() == rows.tolist()
    column = pa.array([[9, 9, 9], *rows.tolist()], pa.list_(pa.float64()))
    assert embeddings.matrix(column.slice(1)).tolist() == rows.tolist() and embeddings.matrix(column.slice(1)).dtype == np.float32
    with pytest.raises(ValueError, match="equally many"):
        embeddings.matrix(pa.array([[1.0], [1.0, 2.0]]))


def test_encoding_in_batches(spark):
    rows = [("s", k, 1, [float(k), 2.0, -k / 4]) for k in range(700)]
    samples = spark.createDataFrame(rows, "slide_name string, x int, y int, pixels array<float>").repartition(3)
    got = {r.x: r.embedding for r in embeddings.encode(samples, embeddings.projection_encoder(4), batch=64, transform="numpy.negative").collect()}
    weights = (7 * np.arange(3)[:, None] + 13 * np.arange(4)) % 11 - 5
    assert got == {k: (-np.array(v, np.float32) @ weights.astype(np.float32)).tolist() for _, k, _, v in rows}


def test_names_are_made_below_the_join(spark):
    slides = spark.createDataFrame([("/d/a.b.mrxs", "1", 0, 8, 8), ("/d/none.mrxs", "2", 0, 8, 8)], SLIDES)
    tiles = spark.createDataFrame([("1", 0, 0), ("1", 8, 0), ("3", 0, 0)], "slide_id string, tile_x int, tile_y int")
    found = dataset.samples_of(slides, tiles)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, dataset.tile_samples(dataset.link_tiles(slides, tiles)).collect())) == [("a.b", "1", 0, 0), ("a.b", "1", 8, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("regexp_replace")
