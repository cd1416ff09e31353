"""Slides and their tiles as one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.paths import stem


def rename_coordinates(tiles: DataFrame) -> DataFrame:
    """tile_x, tile_y become x, y where they are present."""
    return tiles.withColumnsRenamed({"tile_x": "x", "tile_y": "y"}) if "tile_x" in tiles.columns else tiles


def link_tiles(slides: DataFrame, tiles: DataFrame, how: str = "inner") -> DataFrame:
    """Each tile with its slide's path and level: one join in place of a filter per slide. `left` keeps slides without tiles.

    Tiles are many more than their plan or files tell, so the join is never a broadcast; a task holds its share of the slides, and tiles are neither held nor sorted.
    """
    parents = slides.select("id", "path", "level", "tile_extent_x", "tile_extent_y").hint("shuffle_hash")
    children = rename_coordinates(tiles)
    return parents.join(children, parents.id == children.slide_id, how).drop("id")


def tile_samples(linked: DataFrame) -> DataFrame:
    """slide_name (the file's stem), slide_id and integer coordinates; numbers beyond the range raise."""
    return linked.select(stem(F.col("path")).alias("slide_name"), "slide_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def samples_of(slides: DataFrame, tiles: DataFrame) -> DataFrame:
    """`tile_samples` of the tiles of `slides`: names are made once for each slide, before it meets its tiles."""
    parents = slides.select("id", stem(F.col("path")).alias("slide_name")).hint("shuffle_hash")
    children = rename_coordinates(tiles)
    return parents.join(children, parents.id == children.slide_id).select("slide_name", "slide_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
