"""The slide table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.paths import slide_path


def slide_metadata(mapping: DataFrame, suffix: str = ".mrxs") -> DataFrame:
    return mapping.select(slide_path(F.col("path"), suffix).alias("slide_path"), "type", "risk_index")


def choose_level(levels: DataFrame, mpp: float) -> DataFrame:
    """One row per slide: the level whose resolution is nearest to `mpp`, the smaller level at a tie."""
    off = F.struct(F.abs((F.col("mpp_x") + F.col("mpp_y")) / 2 - F.lit(mpp)), F.col("level"))
    best = levels.groupBy("path").agg(F.min_by(F.struct("level", "mpp_x", "mpp_y", "extent_x", "extent_y"), off).alias("best"))
    return best.select("path", "best.*")


def read_slides(levels: DataFrame, mpp: float, tile_extent: int, stride: int) -> DataFrame:
    """Slides at the chosen level, stamped with tile extent and stride."""
    size = {f"{name}_{axis}": F.lit(value) for name, value in (("tile_extent", tile_extent), ("stride", stride)) for axis in "xy"}
    return choose_level(levels, mpp).withColumns(size)


def join_metadata(slides: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left outer: slides without metadata get nulls, and a path listed n times gives n rows. Both grow alike, so neither is broadcast."""
    return slides.join(metadata.hint("merge"), slides.path == metadata.slide_path, "left_outer").drop("slide_path")


def add_id(slides: DataFrame) -> DataFrame:
    """`id` from what identifies a slide, so that slide and tile tables agree however often they are computed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "level", "extent_x", "extent_y", "tile_extent_x", "tile_extent_y", "stride_x", "stride_y", "type") if c in slides.columns]
    return slides.withColumn("id", F.sha2(F.concat_ws("|", *parts), 256))
