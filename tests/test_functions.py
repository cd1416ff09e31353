import math
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.functions import geometry, labels, paths, vectors
from tilewright.functions.overlap import overlap_score, positive


def test_stem_like_pathlib(spark):
    names = ["/x/y.z.mrxs", "noext", ".hid", "..a", "x.tar.gz", "a/b/", "a/b.c/", "/d/Brand#1.7.mrxs", "é.ö.tif", None]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.stem(F.col("p")).alias("s"), paths.with_suffix_name(F.col("p")).alias("m")).collect()
    for r in rows:
        assert r.s == (None if r.p is None else PurePosixPath(r.p).stem)
        assert r.m == (None if r.p is None else PurePosixPath(r.p).stem + ".tiff")


def test_embedding_keys_of_dotted_stems(spark):
    df = spark.createDataFrame([("case.1.mrxs",), ("case.2.mrxs",)], "p string")
    assert [r[0] for r in df.select(paths.embedding_key(F.col("p"), "reference")).collect()] == ["case", "case"]
    assert [r[0] for r in df.select(paths.embedding_key(F.col("p"))).collect()] == ["case.1", "case.2"]
    with pytest.raises(ValueError):
        paths.embedding_key(F.col("p"), "other")


def test_mask_paths(spark):
    df = spark.createDataFrame([("/d/a.b.mrxs",)], "p string")
    p = F.col("p")
    row = df.select(paths.mask_path(p, "/t/"), paths.mask_path(p, None), paths.qc_mask_path(p, "/q", "folding"), paths.qc_mask_path(p, None, "blur")).first()
    assert list(row) == ["/t/a.b.tiff", "", "/q/FoldingFunction_folding_test_a.b.tiff", ""]


def test_rois():
    assert geometry.center_roi(224) == (56, 56, 168, 168)
    assert geometry.center_roi(225)[:1] + geometry.center_roi(225)[2:3] == (56, 168)
    assert geometry.center_roi(226)[2] == 169
    assert geometry.full_roi(512) == (0, 0, 512, 512)


@pytest.mark.parametrize(("extent", "keep"), [(1, 1), (64, 1), (65, 2), (96, 2), (97, 3), (128, 3)])
def test_grid_counts(spark, extent, keep):
    row = spark.range(1).select(*[geometry.grid_count(F.lit(extent), F.lit(64), F.lit(32), last).alias(last) for last in geometry.LAST]).first()
    assert row.keep == keep == row.shift
    assert row.drop == (0 if extent < 64 else (extent - 64) // 32 + 1)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 90), st.integers(1, 90)), min_size=1, max_size=15))
def test_grid_covers_and_repeats_nothing(spark, sizes):
    from tilewright.operators.grid import grid_tiles

    df = spark.createDataFrame([(i, e, t, min(s, t)) for i, (e, t, s) in enumerate(sizes)], "k int, e int, t int, s int")
    df = df.select("k", *[F.col(c).alias(f"{n}_{a}") for c, n in (("e", "extent"), ("t", "tile_extent"), ("s", "stride")) for a in "xy"])
    found = {}
    for r in grid_tiles(df).collect():
        found.setdefault(r.k, []).append((r.tile_x, r.tile_y))
    for i, (e, t, s) in enumerate(sizes):
        s = min(s, t)
        xs = sorted({x for x, _ in found[i]})
        assert len(set(found[i])) == len(found[i]) == len(xs) ** 2
        assert all(x % s == 0 for x in xs)
        assert xs[0] == 0 and xs[-1] + t >= e and all(b - a <= t for a, b in zip(xs, xs[1:]))


def test_overlap_modes(spark):
    rows = [(1, None), (2, {}), (3, {"0": None}), (4, {"0": 0.0}), (5, {"0": 0.25}), (6, {"0": 1.0}), (7, {"255": 1.0}), (8, {"0": math.nan})]
    df = spark.createDataFrame(rows, "n int, m map<string,double>")
    got = df.select(overlap_score(F.col("m"), "0").alias("r"), overlap_score(F.col("m"), "0", "documented").alias("d"), positive(overlap_score(F.col("m"), "0")).alias("keep")).collect()
    assert [r.r for r in got[:7]] == [0.0, 0.0, 0.0, 0.0, 0.75, 0.0, 0.0]
    assert [r.d for r in got[:7]] == [0.0, 1.0, 1.0, 1.0, 0.75, 0.0, 1.0]
    assert math.isnan(got[7].r) and not got[7].keep


def test_labels(spark):
    df = spark.createDataFrame([("/a/s.1.mrxs", "a luminal", "1.5"), ("t.mrxs", "b luminal", "2")], "path string, type string, idx string")
    got = labels.process_slides(df, "type").select("name", labels.label_value("type").alias("v")).collect()
    assert [(r.name, r.v) for r in got] == [("s.1", 1), ("t", 0)]
    got = labels.process_slides(df, "index", "idx").select(labels.label_value("index").alias("v"))
    assert got.dtypes == [("v", "float")] and [r.v for r in got.collect()] == [1.5, 2.0]
    assert labels.process_slides(df).columns == ["path", "type", "idx", "name"]
    assert (labels.target_column("type"), labels.target_column("index")) == ("type_label", "index")
    for bad in ("A luminal", None, "c"):
        with pytest.raises(Exception, match="Unknown luminal type label"):
            spark.createDataFrame([(bad,)], "type string").select(labels.luminal_label(F.col("type"))).collect()
    with pytest.raises(ValueError):
        labels.label_value("other")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        labels.process_slides(spark.createDataFrame([("p", "x", "no")], "path string, type string, idx string"), "index", "idx").collect()


def test_vectors(spark):
    tokens = [[1.0, 2.0], [9.0, 9.0], [9.0, 9.0], [9.0, 9.0], [9.0, 9.0], [3.0, 5.0], [5.0, 9.0]]
    df = spark.createDataFrame([(tokens, [0.0, 255.0, 127.5, 255.0])], "t array<array<float>>, p array<float>")
    row = df.select(vectors.class_and_mean(F.col("t")).alias("v"), vectors.normalize_channels(F.col("p")).alias("n")).first()
    assert row.v == [1.0, 2.0, 4.0, 7.0]
    assert row.n == pytest.approx([(v / 255 - m) / d for v, m, d in zip([0, 255, 127.5, 255], (0.485, 0.456, 0.406, 0.485), (0.229, 0.224, 0.225, 0.229))])
    assert spark.range(1).select(vectors.in_tokens(F.array(*map(F.lit, range(6))), 3)).first()[0] == [[0, 1, 2], [3, 4, 5]]
