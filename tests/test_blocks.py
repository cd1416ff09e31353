from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from tilewright.operators import blocks, dataset, grid, tasks
from tilewright.sources import sinks

SCHEMA = "id string, path string, level int, extent_x int, extent_y int, tile_extent_x int, tile_extent_y int, stride_x int, stride_y int"


def slides(spark, extents):
    rows = [(f"{k:040x}"[::-1], f"/s/{k}", 0, x, y, 64, 64, 32, 32) for k, (x, y) in enumerate(extents)]
    return spark.createDataFrame(rows, SCHEMA)


def test_blocks_have_the_target_size_however_slides_differ(spark):
    """One slide with nine tenths of all tiles, and many of a tile each."""
    table = slides(spark, [(12_000, 3_200)] + [(40, 40)] * 300 + [(200, 100)] * 200)
    got = blocks.tile_blocks(table, target=100, tasks=6)
    want = {(r.id, r.tile_x, r.tile_y) for r in grid.grid_tiles(table).collect()}
    rows = got.select("id", "tile_x", "tile_y", "block", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == len(want) and {(r.id, r.tile_x, r.tile_y) for r in rows} == want
    sizes = Counter(r.block for r in rows)
    assert all(sizes[b] == 100 for b in range(len(sizes) - 1)) and sizes[len(sizes) - 1] <= 100
    held = Counter(r.task for r in rows)
    assert len(held) == 6 and max(held.values()) <= 1.5 * median(held.values())
    assert max(len({r.id for r in rows if r.block == b}) for b in list(sizes)[:5]) >= 1


def test_blocks_of_no_slides(spark):
    assert blocks.tile_blocks(slides(spark, [])).count() == 0
    assert blocks.tile_blocks(slides(spark, [(32, 32)]), last="drop").count() == 0


def test_linking_a_bucketed_pair_moves_no_row(spark, tmp_path):
    table = slides(spark, [(200, 100)] * 20)
    tiles = grid.grid_tiles(table).select(F.col("id").alias("slide_id"), "tile_x", "tile_y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s, t = sinks.write_buckets(table, tiles, str(tmp_path), "moves_no_row", 4)
        linked = dataset.link_tiles(s, t)
        assert linked.count() == tiles.count()
        for df in (linked, t.groupBy("slide_id").count()):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS moves_no_row_slides")
        spark.sql("DROP TABLE IF EXISTS moves_no_row_tiles")


def test_reports_are_bounded_by_default(spark):
    paths = spark.range(95).select(F.concat(F.lit("/s/"), "id").alias("wsi_path"))
    assert tasks.report_requests(paths, "u/", "m", "s").count() == 1
    parts = [r.payload.count("/s/") for r in tasks.report_requests(paths, "u/", "m", "s", most_paths=10).collect()]
    assert sum(parts) == 95 and len(parts) > 5 and max(parts) < 30
    assert tasks.report_requests(paths.limit(0), "u/", "m", "s").count() == 0
