"""Tiles in blocks of a target number of rows, and tasks of equal numbers of blocks.

How many tiles a slide has is known before it is expanded. So slides are numbered through by prefix sums of their counts, cut into blocks where a multiple of the
target is passed, and only then expanded: a giant slide is spread over many tasks, small ones share a block, and what is shuffled is a row for each slide and block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import geometry

TARGET = 256


def numbered(slides: DataFrame, last: str = "keep") -> DataFrame:
    """`slides` (with `id`, a hex digest) with n_x and n_y, the tiles along each axis, and `start`, the number of tiles of slides with smaller ids.

    Sums are taken within the 256 ranges of the first two digits; only the sums of the ranges meet in one task.
    """
    count = lambda a: geometry.grid_count(*[F.col(f"{n}_{a}") for n in ("extent", "tile_extent", "stride")], last)
    n = F.col("n_x").cast("bigint") * F.col("n_y")
    counted = slides.withColumns({"n_x": count("x"), "n_y": count("y"), "_range": F.substring("id", 1, 2)})
    ranges = counted.groupBy("_range").agg(F.sum(n).alias("n")).select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    within = F.coalesce(F.sum(n).over(Window.partitionBy("_range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("_within", within).join(F.broadcast(ranges), "_range").withColumn("start", F.col("_ahead") + F.col("_within")).drop("_range", "_ahead", "_within")


def tile_blocks(slides: DataFrame, target: int = TARGET, tasks: int | None = None, last: str = "keep") -> DataFrame:
    """One row per tile with all columns of its slide, tile_x, tile_y and `block`; each block but the last has `target` tiles, and `tasks` tasks have equally many blocks."""
    known = numbered(slides, last).where("n_x > 0 AND n_y > 0").withColumn("_end", F.col("start") + F.col("n_x").cast("bigint") * F.col("n_y"))
    block = lambda at: F.floor(at / F.lit(target)).cast("bigint")
    cut = known.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("_end") - 1))))
    n = tasks or slides.sparkSession.sparkContext.defaultParallelism
    dealt = cut.repartitionById(n, F.pmod("block", F.lit(n)).cast("int"))
    first, end = F.greatest("start", F.col("block") * target), F.least("_end", (F.col("block") + 1) * target)
    tiles = dealt.withColumn("_tile", F.explode(F.sequence(first - F.col("start"), end - F.col("start") - 1)))
    place = lambda a, index: geometry.grid_start(index, *[F.col(f"{n}_{a}") for n in ("extent", "tile_extent", "stride")], last)
    spread = tiles.withColumns({"tile_x": place("x", F.col("_tile") % F.col("n_x")), "tile_y": place("y", F.expr("_tile div n_x"))})
    return spread.select(*slides.columns, "tile_x", "tile_y", "block")
