"""The flagship: slides to scored tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry, paths
from tilewright.functions.overlap import positive
from tilewright.sources.schemas import TILE_COLUMNS

from .grid import grid_along, grid_tiles
from .masks import CELL, Overlap, mask_strips, with_scores

#: Overlaps in order: column, mask column, whether only the centre counts, undesired pixel value. The first one filters.
OVERLAPS = (
    ("tissue_overlap", "tissue_mask_path", True, "0"),
    ("blur_overlap", "blur_mask_path", False, "255"),
    ("folding_overlap", "folding_mask_path", False, "255"),
    ("residual_overlap", "residual_mask_path", False, "0"),
    ("epithelium_overlap", "epithelium_mask_path", False, "0"),
)
CARRIED = ("mpp_x", "mpp_y", "type", "risk_index")


def overlaps(tile_extent: int) -> list[Overlap]:
    regions = {True: geometry.center_roi(tile_extent), False: geometry.full_roi(tile_extent)}
    return [Overlap(column, path, regions[center], value) for column, path, center, value in OVERLAPS]


@dataclass(frozen=True)
class MaskRoots:
    """Folders of the masks; a missing one disables its kind, whose overlaps are then 0."""

    tissue: str | None = None
    epithelium: str | None = None
    qc: str | None = None


def with_mask_paths(slides: DataFrame, roots: MaskRoots) -> DataFrame:
    path = F.col("path")
    named = {"tissue_mask_path": paths.mask_path(path, roots.tissue), "epithelium_mask_path": paths.mask_path(path, roots.epithelium)}
    return slides.withColumns(named | {f"{kind}_mask_path": paths.qc_mask_path(path, roots.qc, kind) for kind in paths.QC_PREFIXES})


def expand(slides: DataFrame, roots: MaskRoots, last: str = "keep") -> DataFrame:
    """Tiles with the columns that the overlaps need."""
    return grid_tiles(with_mask_paths(slides, roots), last).select("tile_x", "tile_y", F.col("id").alias("slide_id"), *CARRIED, *[path for _, path, _, _ in OVERLAPS])


def score_tiles(slides: DataFrame, masks: DataFrame, overlaps: list[Overlap], roots: MaskRoots, mode: str = "reference", last: str = "keep", kept: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """slide_id, `carried`, tile_y, tile_x and a score per overlap of every tile; `kept`: of those whose first score is positive.

    Stretches of grid rows get the mask sums they need, score their tiles, and only then spread into tiles: no tile is shuffled. The other scores are computed for
    kept tiles alone.
    """
    sources = with_mask_paths(slides, roots).withColumnRenamed("id", "slide_id")
    n = F.col("_n")
    place = lambda i: geometry.grid_start(i, F.col("extent_x"), F.col("tile_extent_x"), F.col("stride_x"), last)
    rows = grid_along(sources, "y", last).withColumn("_n", geometry.grid_count(F.col("extent_x"), F.col("tile_extent_x"), F.col("stride_x"), last)).where(n > 0)
    stretches = rows.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / CELL).cast("int"))))
    stretches = stretches.withColumn("first", F.col("stretch") * CELL).withColumn("end", F.least(n, F.col("first") + CELL)).withColumn("x_from", place(F.col("first"))).withColumn("x_to", place(F.col("end") - 1))
    key = ["slide_id", "tile_y", "stretch"]
    strips = mask_strips(stretches, masks, overlaps, key)
    met = stretches.join(strips.hint("merge"), key, "inner" if kept else "left")  # a stretch without any mask has no tissue
    held = [f"{n}{i}" for i in range(len(overlaps)) for n in "mfpcn"]
    tiles = met.select("slide_id", *carried, "tile_y", "mpp_x", "extent_x", "tile_extent_x", "stride_x", *held, F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("_i")).withColumn("tile_x", place(F.col("_i")))
    tiles = with_scores(tiles, {0: overlaps[0]}, mode)
    if kept:  # by a generator: a filter would be pushed below the score, and compute it twice
        tiles = tiles.select("*", F.explode(F.when(positive(F.col(overlaps[0].column)), F.array(F.lit(0)))).alias("_kept"))
    scored = with_scores(tiles, {i: o for i, o in enumerate(overlaps) if i}, mode) if len(overlaps) > 1 else tiles
    return scored.select("slide_id", *carried, "tile_y", "tile_x", *[o.column for o in overlaps])


def tile_slides(slides: DataFrame, masks: DataFrame, tile_extent: int, roots: MaskRoots, mode: str = "reference", last: str = "keep") -> DataFrame:
    """Ten columns per tile that has tissue in its centre."""
    return score_tiles(slides, masks, overlaps(tile_extent), roots, mode, last, kept=True, carried=("type", "risk_index")).select(*TILE_COLUMNS)
