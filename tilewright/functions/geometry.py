"""Tile geometry: integer boxes and grid counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST = ("keep", "drop", "shift")


class Box(NamedTuple):
    """An axis-aligned box in tile pixels, ends exclusive."""

    x0: int
    y0: int
    x1: int
    y1: int


def center_roi(tile_extent: int) -> Box:
    """The centre box of half the tile's side; integer division puts it off centre where 4 doesn't divide the side."""
    offset, size = tile_extent // 4, tile_extent // 2
    return Box(offset, offset, offset + size, offset + size)


def full_roi(tile_extent: int) -> Box:
    return Box(0, 0, tile_extent, tile_extent)


def grid_count(extent: Column, tile: Column, stride: Column, last: str = "keep") -> Column:
    """Tiles along one axis. `keep`: the last may hang over; `drop`: only whole tiles; `shift`: the last is moved back to end at the edge."""
    if last not in LAST:
        raise ValueError(f"last must be one of {LAST}")
    steps = (extent - tile) / stride
    if last == "drop":
        return F.greatest(F.lit(0), F.floor(steps).cast("int") + 1)
    return F.greatest(F.lit(1), F.ceil(steps).cast("int") + 1)


def grid_start(index: Column, extent: Column, tile: Column, stride: Column, last: str = "keep") -> Column:
    at = (index * stride).cast("int")
    return F.greatest(F.lit(0), F.least(at, extent - tile)) if last == "shift" else at
