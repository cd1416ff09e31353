"""Tiled files of several levels (BigTIFF, deflated 8-bit tiles) as a Spark data source.

    register(spark)
    spark.read.format("tiles").load(folder)                       # one row per file and level, see LEVELS
    parts.write.format("tiles").mode("append").save(folder)       # rows of (name, level, tile_y, tile_x, content)

A file is the contents of its rows, one after the other: a header first, which holds the table of offsets of every level, then the tiles. So files are written as
streams, and of a file only its header is read until tiles are asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage

from .graymaps import MANY, RANGE, Files, FileWriter, HeaderReader, Written, located

LEVELS = "path string, level int, mpp_x double, mpp_y double, extent_x int, extent_y int, file string, side int, offsets array<bigint>, sizes array<bigint>"
PARTS = ["name", "level", "tile_y", "tile_x", "content"]
#: Fixed values of the format: types of fields with their sizes and codes, and the tags used here.
TYPES = {3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 16: (8, "Q")}
REDUCED, WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, X_RESOLUTION, Y_RESOLUTION, UNIT, TILE_WIDTH, TILE_LENGTH, OFFSETS, COUNTS = 254, 256, 257, 258, 259, 262, 277, 282, 283, 296, 322, 323, 324, 325
DEFLATE, CENTIMETRE = 8, 3
#: Pixels per centimetre are given as PER_CM / n, so resolutions are kept to 1 / 100,000 of a micron.
PER_CM, STEPS = 1_000_000_000, 100_000
#: Bytes that are read of a file at first; pixels that are handed on at a time.
FIRST_BYTES, CELLS = 1 << 14, 1 << 20


def header(levels: list[tuple[int, int, float | None, float | None, list[int]]], side: int) -> bytes:
    """The first bytes of a file: for each level its width, height, resolution along both axes and the sizes of its tiles in row order."""

    def fields(k: int, offsets: list[int]) -> list[tuple[int, int, list[int]]]:
        width, height, mpp_x, mpp_y, sizes = levels[k]
        axes = [(tag, 5, [PER_CM, round(mpp * STEPS)]) for tag, mpp in ((X_RESOLUTION, mpp_x), (Y_RESOLUTION, mpp_y)) if mpp]
        return [
            (REDUCED, 4, [int(k > 0)]), (WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]),
            *axes, *([(UNIT, 3, [CENTIMETRE])] if axes else []), (TILE_WIDTH, 4, [side]), (TILE_LENGTH, 4, [side]), (OFFSETS, 16, offsets), (COUNTS, 16, sizes),
        ]

    def length(k: int) -> int:
        return 16 + 20 * len(fields(k, [])) + 2 * 8 * len(levels[k][4]) * (len(levels[k][4]) > 1)

    starts = np.cumsum([16] + [length(k) for k in range(len(levels))]).tolist()
    out, at = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, starts[0])), starts[-1]
    for k, (*_, sizes) in enumerate(levels):
        places = np.cumsum([at, *sizes]).tolist()
        at = places[-1]
        entries = fields(k, places[:-1])
        beyond, tail = starts[k] + 16 + 20 * len(entries), bytearray()
        out += struct.pack("<Q", len(entries))
        for tag, kind, values in entries:
            data = struct.pack(f"<{len(values)}{TYPES[kind][1][0]}", *values)
            out += struct.pack("<HHQ", tag, kind, len(values) // len(TYPES[kind][1]))
            out += data.ljust(8, b"\0") if len(data) <= 8 else struct.pack("<Q", beyond + len(tail))
            tail += data if len(data) > 8 else b""
        out += struct.pack("<Q", starts[k + 1] if k + 1 < len(levels) else 0) + tail
    return bytes(out)


def read_levels(read_at: Callable[[int, int], bytes]) -> Iterator[dict[int, list[int]]]:
    """The tags of each level, by reads of (bytes, offset)."""
    mark, version, size, _, at = struct.unpack("<2sHHHQ", read_at(16, 0).ljust(16, b"\0"))
    if (mark, version, size) != (b"II", 43, 8):
        raise ValueError("not a little-endian BigTIFF")
    while at:
        n = struct.unpack("<Q", read_at(8, at))[0]
        data, found = read_at(20 * n + 8, at + 8), {}
        if len(data) < 20 * n + 8:
            raise ValueError("the header is cut short")
        for k in range(n):
            tag, kind, count = struct.unpack_from("<HHQ", data, 20 * k)
            if kind not in TYPES:
                continue
            size, code = TYPES[kind]
            inline = data[20 * k + 12 : 20 * k + 20]
            values = inline if size * count <= 8 else read_at(size * count, struct.unpack("<Q", inline)[0])
            found[tag] = list(struct.unpack(f"<{count * len(code)}{code[0]}", values[: size * count]))
        yield found
        at = struct.unpack_from("<Q", data, 20 * n)[0]


def buffered(opened) -> Callable[[int, int], bytes]:
    """Reads of (bytes, offset) of an open file; those in its first kilobytes come from one read."""
    first = opened.read_at(FIRST_BYTES, 0)
    return lambda n, at: first[at : at + n] if at + n <= len(first) else opened.read_at(n, at)


class LevelReader(HeaderReader):
    suffix = ".tiff"

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in self.names(partition):
            system, path = located(name)
            with system.open_input_file(path) as opened:
                for level, tags in enumerate(read_levels(buffered(opened))):
                    if tags.get(COMPRESSION) != [DEFLATE] or tags.get(TILE_WIDTH) != tags.get(TILE_LENGTH) or tags.get(BITS) != [8]:
                        raise ValueError(f"not in deflated square tiles of 8 bits: {name}")
                    mpp = [round(10_000 * tags[t][1] / tags[t][0], 5) if t in tags else None for t in (X_RESOLUTION, Y_RESOLUTION)]
                    yield name, level, *mpp, tags[WIDTH][0], tags[LENGTH][0], name, tags[TILE_WIDTH][0], tags[OFFSETS], tags[COUNTS]


class PartWriter(FileWriter):
    """Neighbouring rows of one name go to one file, as a stream; files get their places when all tasks have ended."""

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = located(self.folder)
        task, last, out = uuid.uuid4().hex, None, None
        system.create_dir(f"{root}/_{self.job}/{task}", recursive=True)
        try:
            for name, *_, content in rows:
                if name != last:
                    if out:
                        out.close()
                    last, out = name, system.open_output_stream(f"{root}/_{self.job}/{task}/{name}")
                out.write(bytes(content))
        finally:
            if out:
                out.close()
        return Written(task)


class Tiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return LEVELS

    def reader(self, schema) -> DataSourceReader:
        given = self.options.get("filesPerPartition")
        return LevelReader(self.options["path"], int(given or 128), 0 if given else MANY)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() != PARTS:
            raise ValueError("tiled files are written from rows of (name, level, tile_y, tile_x, content)")
        if overwrite:
            raise ValueError("tiled files are only added")
        return PartWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tiles)


def region_tiles(regions: DataFrame, levels: DataFrame) -> DataFrame:
    """path, level, tile_y, tile_x of the tiles that `regions` (path, level, x, y, width, height) meet, each once."""
    held = regions.join(levels.select("path", "level", "extent_x", "extent_y", "side").hint("merge"), ["path", "level"])
    inside = held.where("width > 0 AND height > 0 AND x < extent_x AND y < extent_y AND x + width > 0 AND y + height > 0")
    along = lambda a, size: F.sequence(F.floor(F.greatest(a, F.lit(0)) / F.col("side")), F.floor((F.least(F.col(a) + F.col(size), f"extent_{a}") - 1) / F.col("side")))
    return inside.withColumn("tile_y", F.explode(along("y", "height"))).withColumn("tile_x", F.explode(along("x", "width"))).select("path", "level", F.col("tile_y").cast("int"), F.col("tile_x").cast("int")).distinct()


def spans(rows: list[dict]) -> Iterator[tuple[int, int]]:
    """(begin, end) in rows sorted by offset: neighbouring tiles are one range of bytes, as long as it stays below RANGE."""
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end]["file"] == rows[at]["file"] and rows[end]["offset"] == rows[end - 1]["offset"] + rows[end - 1]["size"] and rows[end]["offset"] + rows[end]["size"] - rows[at]["offset"] <= RANGE:
            end += 1
        yield at, end
        at = end


def read_tiles(wanted: DataFrame, levels: DataFrame) -> DataFrame:
    """path, level, y, x, row: the lines of the tiles `wanted` (path, level, tile_y, tile_x, each once), cut at the level's edges; x is where a line begins.

    Places come from the table of offsets, ranges of bytes are planned from them, and the tiles of a large file are dealt to several tasks.
    """
    per_line = F.ceil(F.col("extent_x") / F.col("side"))
    at = (F.col("tile_y") * per_line + F.col("tile_x")).cast("int")
    planned = wanted.join(levels.hint("merge"), ["path", "level"]).where(F.col("tile_x").between(0, per_line - 1) & (F.col("tile_y") >= 0) & (at < F.size("offsets")))
    planned = planned.select("path", "level", "tile_y", "tile_x", "extent_x", "extent_y", "side", "file", F.get("offsets", at).alias("offset"), F.get("sizes", at).alias("size"))
    spark = wanted.sparkSession
    # The number is given: planned by bytes of places, a few tasks would read all tiles.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = planned.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def handed(held: list[tuple[dict, np.ndarray]]) -> pa.RecordBatch:
        """The lines of tiles as one batch."""
        tall, wide = (np.array([c.shape[axis] for _, c in held]) for axis in (0, 1))
        each = lambda values: np.repeat(np.array(values, np.int32), tall)
        top = [r["tile_y"] * r["side"] for r, _ in held]
        y = each(top) + np.arange(int(tall.sum()), dtype=np.int32) - np.repeat(np.cumsum(tall) - tall, tall).astype(np.int32)
        pixels = pa.array(np.concatenate([c.ravel() for _, c in held]).astype(np.int16))
        row = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.repeat(wide, tall))]).astype(np.int32)), pixels)
        path = pa.array([r["path"] for r, _ in held]).take(pa.array(np.repeat(np.arange(len(held)), tall)))
        return pa.RecordBatch.from_arrays([path, pa.array(each([r["level"] for r, _ in held])), pa.array(y), pa.array(each([r["tile_x"] * r["side"] for r, _ in held])), row], names=["path", "level", "y", "x", "row"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        for batch in batches:
            rows = batch.to_pylist()
            for at, end in spans(rows):
                begin, last = rows[at]["offset"], rows[end - 1]
                system, name = located(last["file"])
                with system.open_input_file(name) as opened:
                    data = opened.read_at(last["offset"] + last["size"] - begin, begin)
                for r in rows[at:end]:
                    content, side = data[r["offset"] - begin : r["offset"] - begin + r["size"]], r["side"]
                    tile = np.frombuffer(zlib.decompress(content), np.uint8).reshape(side, side)
                    held.append((r, tile[: r["extent_y"] - r["tile_y"] * side, : r["extent_x"] - r["tile_x"] * side]))
                    cells += side**2
                    if cells >= CELLS:
                        yield handed(held)
                        held, cells = [], 0
        if held:
            yield handed(held)

    return dealt.mapInArrow(read, "path string, level int, y int, x int, row array<smallint>")
