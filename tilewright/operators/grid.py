"""Slides to tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry


def grid_along(df: DataFrame, axis: str, last: str = "keep") -> DataFrame:
    """One row per place along one axis, as `tile_<axis>`, with all columns of `df`: a generator, so no shuffle."""
    size = [F.col(f"{n}_{axis}") for n in ("extent", "tile_extent", "stride")]
    n = geometry.grid_count(*size, last)
    places = df.withColumn("_place", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    return places.withColumn(f"tile_{axis}", geometry.grid_start(F.col("_place"), *size, last)).drop("_place")


def grid_tiles(slides: DataFrame, last: str = "keep") -> DataFrame:
    """One row per grid position, with all columns of the slide."""
    return grid_along(grid_along(slides, "y", last), "x", last)
