"""Mask rows to tiled files of several levels, each half as fine as the one before.

Lines are cut into pieces of a tile's width before they move, so no group is larger than a tile. A level follows from the one before tile by tile: each is halved where it
is, and four quarters meet. Masks of WHOLE pixels at most are whole files made by one call instead. A pixel of a coarser level is the greatest of the four below it, so a mask doesn't lose what is thin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.sources import tiffs
from tilewright.sources.scratch import drop_folder, fresh_folder, stored

from .groups import codes, dealt_by, flat, starts_of, whole_groups

SIDE = 256
#: Pixels of the longer side of masks that are written by one call, a whole file each.
WHOLE = 1024
TILE = "mask_path string, level int, tile_y int, tile_x int, content binary"


def base_tiles(rows: DataFrame, side: int = SIDE) -> DataFrame:
    """mask_path, level 0, tile_y, tile_x, content: deflated tiles of mask rows (mask_path, y, row). Missing lines and what lies beyond the edges are 0; of lines of one number the greatest stands."""
    n = F.ceil(F.size("row") / side).cast("int")
    cut = rows.where("mask_path IS NOT NULL AND size(row) > 0").select("mask_path", "y", "row", F.explode(F.sequence(F.lit(0), n - 1)).alias("tile_x"))
    piece = F.struct((F.col("y") % side).cast("int").alias("line"), F.slice("row", F.col("tile_x") * side + 1, F.lit(side)).alias("row"))
    pieces = cut.groupBy("mask_path", F.floor(F.col("y") / side).cast("int").alias("tile_y"), "tile_x").agg(F.collect_set(piece).alias("pieces"))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            contents = []
            for held in frame["pieces"]:
                cells = np.zeros((side, side), np.uint8)
                for p in sorted(held, key=lambda p: (p["line"], list(p["row"]))):
                    cells[p["line"], : len(p["row"])] = p["row"]
                contents.append(zlib.compress(cells.tobytes()))
            yield frame[["mask_path", "tile_y", "tile_x"]].assign(level=0, content=contents)[["mask_path", "level", "tile_y", "tile_x", "content"]]

    return pieces.mapInPandas(fill, TILE)


def halved(tiles: DataFrame, side: int) -> DataFrame:
    """The next level of tiles of one level."""
    half = side // 2

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            small = [zlib.compress(np.frombuffer(zlib.decompress(c), np.uint8).reshape(half, 2, half, 2).max((1, 3)).tobytes()) for c in frame["content"]]
            yield frame.assign(content=small)

    def paste(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            contents = []
            for quarters in frame["quarters"]:
                cells = np.zeros((2, half, 2, half), np.uint8)
                for q in quarters:
                    cells[q["v"], :, q["u"]] = np.frombuffer(zlib.decompress(q["content"]), np.uint8).reshape(half, half)
                contents.append(zlib.compress(cells.tobytes()))
            yield frame[["mask_path", "level", "tile_y", "tile_x"]].assign(content=contents)

    quarter = F.struct((F.col("tile_y") % 2).alias("v"), (F.col("tile_x") % 2).alias("u"), "content")
    key = ["mask_path", (F.col("level") + 1).alias("level"), F.expr("tile_y div 2").cast("int").alias("tile_y"), F.expr("tile_x div 2").cast("int").alias("tile_x")]
    return tiles.mapInPandas(shrink, TILE).groupBy(*key).agg(F.collect_list(quarter).alias("quarters")).mapInPandas(paste, TILE)


def extents(rows: DataFrame) -> DataFrame:
    """mask_path, mpp_x, mpp_y, width and height of mask rows; every mask has all tiles of its grid in its file."""
    return rows.where("mask_path IS NOT NULL AND size(row) > 0").groupBy("mask_path").agg(F.max("mpp_x").alias("mpp_x"), F.max("mpp_y").alias("mpp_y"), F.max(F.size("row")).alias("width"), (F.max("y") + 1).alias("height"))


def write_pyramids(rows: DataFrame, folder: str, side: int = SIDE) -> int:
    """Adds a file for each mask of `rows` (mask_path, y, mpp_x, mpp_y, row) to `folder`, named as the last part of its path; returns the number of levels of the largest.

    `side` is a multiple of 16. Levels go on until one tile holds the mask. Masks without pixels get no file; two masks of one name would get one file, so that raises.
    Nothing larger than a tile is in one row, but for the header of a file, with 16 bytes for each of its tiles, and files of small masks.
    """
    if side % 16:
        raise ValueError("the side of a tile is a multiple of 16")
    tiffs.register(rows.sparkSession)
    kept = fresh_folder(rows.sparkSession, "levels")
    try:
        return _write(rows, folder, side, kept)
    finally:
        drop_folder(rows.sparkSession, kept)


def _write(rows: DataFrame, folder: str, side: int, kept: str) -> int:
    """What `write_pyramids` does, with tables for the time being below `kept`."""
    sizes = stored(extents(rows).withColumn("name", F.regexp_extract("mask_path", "([^/]*)$", 1)), f"{kept}/sizes")
    if not sizes.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("two masks have one name")
    longer = F.greatest("width", "height")
    largest, small = sizes.agg(F.max(longer), F.count(F.when(longer <= WHOLE, 1))).first()
    if largest is None:
        return 0
    if small:
        held = rows.where("mask_path IS NOT NULL AND size(row) > 0 AND y >= 0")
        if largest > WHOLE:
            held = held.join(sizes.where(longer <= WHOLE).select("mask_path").hint("shuffle_hash"), "mask_path", "left_semi")
        _write_whole(held, folder, side)
    n = max(0, (-(-largest // side) - 1).bit_length())
    if largest <= WHOLE:
        return n + 1
    sizes = sizes.where(longer > WHOLE)
    rows = rows.join(sizes.select("mask_path").hint("shuffle_hash"), "mask_path", "left_semi")
    grid = lambda a, level: F.ceil(F.ceil(F.col(a) / F.pow(F.lit(2), level)) / side).cast("int")
    coarser = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: side * F.pow(F.lit(2), k) < F.greatest("width", "height"))
    depth = sizes.withColumn("depth", F.size(coarser))
    level, n = stored(base_tiles(rows, side), f"{kept}/level-0"), 0
    found = level
    while side << n < largest:
        n += 1
        going = depth.where(F.col("depth") >= n).select("mask_path")
        level = stored(halved(level.join(going.hint("shuffle_hash"), "mask_path", "left_semi"), side), f"{kept}/level-{n}")
        found = found.union(level)
    # Tiles none of whose lines was given are put in, so that the grid of each level is whole.
    blank = zlib.compress(bytes(side * side))
    cells = depth.withColumn("level", F.explode(F.sequence(F.lit(0), "depth"))).select("mask_path", "name", "level", grid("width", F.col("level")).alias("_nx"), grid("height", F.col("level")).alias("_ny"))
    cells = cells.withColumn("tile_y", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1))).withColumn("tile_x", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)))
    whole = cells.join(found.hint("merge"), ["mask_path", "level", "tile_y", "tile_x"], "left").select("mask_path", "name", "level", "tile_y", "tile_x", F.coalesce("content", F.lit(blank)).alias("content"))
    whole = stored(whole, f"{kept}/whole")
    table = whole.groupBy("mask_path").agg(F.array_sort(F.collect_list(F.struct("level", "tile_y", "tile_x", F.length("content").alias("size")))).alias("tiles"))

    def head(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            contents = []
            for width, height, mpp_x, mpp_y, held in zip(frame["width"], frame["height"], frame["mpp_x"], frame["mpp_y"], frame["tiles"], strict=True):
                by_level: dict[int, list[int]] = {}
                for t in held:
                    by_level.setdefault(t["level"], []).append(t["size"])
                mpp = [None if pd.isna(m) else float(m) for m in (mpp_x, mpp_y)]
                contents.append(tiffs.header([(-(-int(width) >> k), -(-int(height) >> k), *(m and m * 2**k for m in mpp), by_level[k]) for k in sorted(by_level)], side))
            yield frame[["name"]].assign(level=-1, tile_y=0, tile_x=0, content=contents)

    heads = sizes.join(table.hint("merge"), "mask_path").mapInPandas(head, "name string, level int, tile_y int, tile_x int, content binary")
    parts = heads.union(whole.select(*tiffs.PARTS))
    parts.repartition("name").sortWithinPartitions("name", "level", "tile_y", "tile_x").write.format("tiles").mode("append").save(folder)
    return n + 1


def _write_whole(rows: DataFrame, folder: str, side: int) -> None:
    """Files of masks that one call can hold: their lines meet in one task, and each file is one row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["mask_path"]):
            path = table.column("mask_path")
            y = table.column("y").to_numpy()
            values, offsets = flat(table.column("row"))
            values = values.astype(np.uint8)
            starts = starts_of(codes(path))
            mpp = [(table.column(c).to_numpy(), ~pc.is_null(table.column(c)).to_numpy()) for c in ("mpp_x", "mpp_y")]
            names, contents = [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(y)], strict=True):
                best = [m[a:b][given[a:b]].max() if given[a:b].any() else np.nan for m, given in mpp]
                names.append(path[a].as_py().rsplit("/", 1)[-1])
                contents.append(file_of(y[a:b], values, offsets[a : b + 1], [None if np.isnan(m) else float(m) for m in best], side))
            zeros = pa.array(np.zeros(len(names), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), -1, np.int32)), zeros, zeros, pa.array(contents, pa.binary())], names=tiffs.PARTS)

    lines = rows.select("mask_path", F.col("y").cast("int").alias("y"), F.col("mpp_x").cast("double").alias("mpp_x"), F.col("mpp_y").cast("double").alias("mpp_y"), F.col("row").cast("array<smallint>").alias("row"))
    dealt_by(lines, ["mask_path"], ["y"]).mapInArrow(build, "name string, level int, tile_y int, tile_x int, content binary").write.format("tiles").mode("append").save(folder)


def file_of(y: np.ndarray, values: np.ndarray, offsets: np.ndarray, mpp: list[float | None], side: int) -> bytes:
    """A mask's file: its lines have the numbers `y`, in order, and the pixels `values` between `offsets`."""
    n = np.diff(offsets)
    width, height = int(n.max()), int(y[-1]) + 1
    cells = np.zeros((-(-height // side) * side, -(-width // side) * side), np.uint8)
    if (n == width).all() and (np.diff(y) > 0).all():
        cells[y, :width] = values[offsets[0] : offsets[-1]].reshape(-1, width)
    else:
        # Of lines of one number the greatest stands, tile by tile.
        for x in range(0, cells.shape[1], side):
            for line, piece in sorted((int(line), values[a + x : min(b, a + x + side)].tolist()) for line, a, b in zip(y, offsets, offsets[1:], strict=False) if b > a + x):
                cells[line, x : x + len(piece)] = piece
    levels, tiles = [], []
    while True:
        k = len(levels)
        wide, tall = -(-width >> k), -(-height >> k)
        grid = cells.reshape(cells.shape[0] // side, side, -1, side).swapaxes(1, 2).reshape(-1, side * side)
        own = [zlib.compress(t.tobytes()) for t in grid]
        levels.append((wide, tall, *(m and m * 2**k for m in mpp), [len(t) for t in own]))
        tiles += own
        if max(wide, tall) <= side:
            return tiffs.header(levels, side) + b"".join(tiles)
        half = cells.reshape(cells.shape[0] // 2, 2, -1, 2).max((1, 3))
        cells = np.zeros(tuple(-(-m // side) * side for m in (-(-height >> k + 1), -(-width >> k + 1))), np.uint8)
        half = half[: cells.shape[0], : cells.shape[1]]
        cells[: half.shape[0], : half.shape[1]] = half
