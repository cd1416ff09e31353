"""Many small groups are worked on by whole batches: none is split, and none has a call or a frame of its own."""

import inspect

import numpy as np
import pyarrow as pa
import pytest

from tilewright.operators import groups, segmentation


def test_no_group_is_split():
    draw = np.random.default_rng(3)
    keys = np.sort(draw.integers(0, 40, 500))
    rows = [(f"k{k:02d}", int(k) % 3, n) for n, k in enumerate(keys)]
    for size in (1, 3, 7, 500):
        batches = [pa.RecordBatch.from_pydict({"k": [r[0] for r in part], "b": [r[1] for r in part], "n": [r[2] for r in part]}) for part in (rows[i : i + size] for i in range(0, 500, size))]
        tables = list(groups.whole_groups(iter([batches[0].slice(0, 0), *batches]), ["k", "b"]))
        assert [n for t in tables for n in t.column("n").to_pylist()] == list(range(500))
        seen = [set(t.column("k").to_pylist()) for t in tables]
        assert sum(map(len, seen)) == len(set(keys))
    assert list(groups.whole_groups(iter([]), ["k"])) == []


def test_links_are_followed_to_the_smallest():
    draw = np.random.default_rng(4)
    for _ in range(50):
        n = int(draw.integers(1, 60))
        a, b = draw.integers(0, n, (2, int(draw.integers(0, 60))))
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                label[x] = label[y] = min(label[x], label[y])
        assert groups.joined(n, a, b).tolist() == label


def test_tasks_follow_the_partitions_and_not_the_bytes(spark):
    dealt = groups.dealt_by(spark.range(1000).selectExpr("id % 300 AS k", "id AS n"), ["k"], ["n"])
    assert dealt.rdd.getNumPartitions() == 8
    assert "ASC" in dealt._jdf.queryExecution().executedPlan().toString()


def test_segmentation_has_no_call_per_group():
    """A call per slide and band was the cost of many small slides: over 290 s on 20,000 of them."""
    source = inspect.getsource(segmentation)
    assert "applyInPandas" not in source and "mapInPandas" not in source


def test_pixels_beyond_a_byte_raise(spark):
    lines = spark.createDataFrame([("a", 0, [1, 256])], "path string, y int, row array<smallint>")
    with pytest.raises(Exception, match="pixels are 0 to 255"):
        segmentation.thresholds(lines).collect()
