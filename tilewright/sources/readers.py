"""Sources: the mapping table, slide and tile pairs, and raster files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_mapping(spark: SparkSession, path: str, index: str = "risk_index") -> DataFrame:
    """The CSV of slides and labels, with a declared schema: no inference pass, and digits in a path stay text.

    `index` is the name of the file's third column; it is read as `risk_index`.
    """
    return spark.read.schema(schemas.mapping(index)).option("header", True).option("enforceSchema", False).csv(path).withColumnRenamed(index, "risk_index")


def read_pair(spark: SparkSession, *roots: str, pairs: Sequence[tuple[DataFrame, DataFrame]] = ()) -> tuple[DataFrame, DataFrame]:
    """(slides, tiles) of dataset folders (any URI that Spark reads) and of pairs already loaded, put together by column name."""
    pairs = [*((spark.read.parquet(f"{r}/slides"), spark.read.parquet(f"{r}/tiles")) for r in roots), *pairs]
    if not pairs:
        raise ValueError("no dataset given")
    slides, tiles = pairs[0]
    for s, t in pairs[1:]:
        slides, tiles = slides.unionByName(s), tiles.unionByName(t)
    return slides, tiles


def parse_header(data: bytes) -> tuple[int, int, int, dict[str, str]]:
    """Width, height, begin of the pixels, and `name=value` notes in comments of a binary 8-bit portable graymap."""
    fields, notes, at = [], {}, 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            end = data.index(b"\n", at)
            notes |= dict(w.split("=", 1) for w in data[at + 1 : end].decode("utf-8", "replace").split() if "=" in w)
            at = end
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the header is cut short")
        fields.append(data[at:end])
        at = end
    if fields[0] != b"P5" or int(fields[3]) > 255:
        raise ValueError("not a binary 8-bit graymap")
    return int(fields[1]), int(fields[2]), at + 1, notes


def parse_pgm(data: bytes) -> list[bytes]:
    """Rows of a binary 8-bit portable graymap."""
    width, height, begin, _ = parse_header(data)
    body = data[begin:]
    if len(body) < width * height:
        raise ValueError("the raster is cut short")
    return [body[y * width : (y + 1) * width] for y in range(height)]


def read_levels(spark: SparkSession, glob: str) -> DataFrame:
    """Slide headers of graymap files, see `levels_of`."""
    return levels_of(spark.read.format("binaryFile").load(glob))


def levels_of(files: DataFrame) -> DataFrame:
    """(path, level, mpp_x, mpp_y, extent_x, extent_y) of (path, content): one row per graymap, which holds one level of a slide.

    Comments of its header give slide, level, mpp_x and mpp_y; by default they are the file's own path, 0 and null.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width, height, _, notes = parse_header(content)
                mpp = [float(notes[n]) if n in notes else None for n in ("mpp_x", "mpp_y")]
                out.append((notes.get("slide", path), int(notes.get("level", 0)), *mpp, width, height))
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["path", "level", "mpp_x", "mpp_y", "extent_x", "extent_y"])

    return files.select("path", "content").mapInArrow(rows, schemas.LEVELS)


def read_masks(spark: SparkSession, glob: str, mpp_x: float, mpp_y: float) -> DataFrame:
    """Mask rows from graymap files; each file is decoded where it is read."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = parse_pgm(content)
                yield pa.RecordBatch.from_pydict({"mask_path": [path] * len(lines), "y": pa.array(range(len(lines)), pa.int32()), "row": pa.array([list(x) for x in lines], pa.list_(pa.int16()))})

    decoded = files.mapInArrow(rows, "mask_path string, y int, row array<smallint>")
    return decoded.select("mask_path", "y", F.lit(mpp_x).alias("mpp_x"), F.lit(mpp_y).alias("mpp_y"), "row")
