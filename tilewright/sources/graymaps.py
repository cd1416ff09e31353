"""Graymap files as a Spark data source: headers by reading some kilobytes of each file, and files written with a commit.

    register(spark)
    spark.read.format("graymap").load(folder)            # one row per file, see HEADERS
    files.write.format("graymap").mode("append").save(folder)   # rows of (name, content)

`read_lines` then reads lines by byte ranges, which are planned from what is wanted. Files are reached through Arrow's file systems (local paths and any URI that they know).
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from .readers import parse_header

#: The columns of the source: slide, level and resolution from the header's comments (by default the file itself, 0 and null), sizes, and where the pixels begin.
HEADERS = "path string, level int, mpp_x double, mpp_y double, extent_x int, extent_y int, file string, begin bigint"
#: Bytes that are read of a file at first, and at most before its header has to end; files of a partition; bytes of one range.
FIRST, MOST, FILES, RANGE = 1 << 12, 1 << 16, 512, 1 << 22
BAND = 64
#: Tasks that read headers, as long as each has FILES files at least and MANY at most: a task costs as much as thousands of headers.
TASKS, MANY = 256, 1 << 13
#: Names that the driver holds, and tasks that list a folder of more files: listing it costs each of them about what its share of the headers does with millions of files.
HELD, SHARES = 1 << 16, 32
#: Files that are put in their places at a time where each takes a call to a server, and how many of them one thread takes; pixels that are handed on at a time.
MOVES, EACH, CELLS = 32, 64, 1 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_header(open_file) -> tuple[int, int, int, dict[str, str]]:
    """Width, height, begin of the pixels and notes of an open graymap; of a file of any size some kilobytes are read."""
    data, wanted = b"", FIRST
    while True:
        more = open_file.read(wanted - len(data))
        data += more
        try:
            found = parse_header(data)
            if found[2] <= len(data):
                return found
        except ValueError:
            pass
        if not more or wanted >= MOST:
            return parse_header(data)  # raises what is wrong with it
        wanted *= 2


@dataclass
class Files(InputPartition):
    """Some files of one reader, by their names below `folder`; or those of all files there whose names fall to `share` of `shares`, which the task lists itself."""

    names: list[str]
    folder: str = ""
    share: int = 0
    shares: int = 0


def listed(system: fs.FileSystem, root: str, below: str = "") -> Iterator[str]:
    """The files below a folder, by what their paths have beyond it, one after the other; names that begin with _ are left out, and so is what is in such folders.

    A local folder is never held as a whole; of others Arrow hands on a folder at a time.
    """
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(f"{root}{below}") as entries:
            for e in entries:
                name = e.name
                if name[0] == "_":
                    continue
                if e.is_file():
                    yield f"{below}/{name}"
                elif e.is_dir():
                    yield from listed(system, root, f"{below}/{name}")
        return
    for i in system.get_file_info(fs.FileSelector(f"{root}{below}")):
        if i.is_file and i.base_name[0] != "_":
            yield f"{below}/{i.base_name}"
        elif i.type == fs.FileType.Directory and i.base_name[0] != "_":
            yield from listed(system, root, f"{below}/{i.base_name}")


class HeaderReader(DataSourceReader):
    suffix = ".pgm"

    def __init__(self, folder: str, per_partition: int, most: int = 0) -> None:
        self.folder, self.per_partition, self.most = folder, per_partition, most
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Tests of the column `file` choose which files are opened at all; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("file",):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        return all(name == f.value if isinstance(f, EqualTo) else name in f.value if isinstance(f, In) else name.startswith(f.value) for f in self.tests)

    def _own(self, folder: str) -> Iterator[str]:
        """The names of this reader's files below a folder."""
        system, root = located(folder)
        found = (n for n in listed(system, root) if n.endswith(self.suffix))
        return (n for n in found if self._wanted(folder + n)) if self.tests else found

    def partitions(self) -> list[InputPartition]:
        """By names as long as there are HELD at most. Beyond, nothing of a file is held here: they are only counted, and each of SHARES tasks lists its own."""
        folder = self.folder.rstrip("/")
        names, n = [], 0
        for name in self._own(folder):
            n += 1
            if n <= HELD:
                names.append(name)
            elif names:
                names = []
        size = max(self.per_partition, min(-(-n // TASKS), self.most))
        if n > HELD:
            shares = min(-(-n // size), SHARES)
            return [Files([], folder, k, shares) for k in range(shares)]
        names.sort()
        return [Files(names[k : k + size], folder) for k in range(0, n, size)] or [Files([])]

    def names(self, partition: Files) -> Iterator[str]:
        """The files of a partition, by their whole names."""
        own = (n for n in self._own(partition.folder) if zlib.crc32(n.encode()) % partition.shares == partition.share) if partition.shares else partition.names
        return (partition.folder + n for n in own)

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in self.names(partition):
            system, path = located(name)
            with system.open_input_file(path) as opened:
                width, height, begin, notes = read_header(opened)
            mpp = [float(notes[n]) if n in notes else None for n in ("mpp_x", "mpp_y")]
            yield notes.get("slide", name), int(notes.get("level", 0)), *mpp, width, height, name, begin


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task that ended well; what is sent doesn't grow with its files."""

    task: str


class FileWriter(DataSourceWriter):
    """Tasks write below a folder of the job's own; the files get their places when all tasks have ended, so no reader meets a torn file."""

    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = located(self.folder)
        task = uuid.uuid4().hex
        system.create_dir(f"{root}/_{self.job}/{task}", recursive=True)
        for name, content in rows:
            with system.open_output_stream(f"{root}/_{self.job}/{task}/{name}") as out:
                out.write(bytes(content))
        return Written(task)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.folder)

        def place(names: list[str], task: str) -> None:
            for name in names:
                system.move(f"{root}/_{self.job}/{task}/{name}", f"{root}/{name}")

        with ThreadPoolExecutor(MOVES) as pool:
            for task in (m.task for m in messages if m):
                if isinstance(system, fs.LocalFileSystem):
                    # A file system of one machine moves files of one folder one after the other: threads would only wait for each other.
                    for name in os.listdir(f"{root}/_{self.job}/{task}"):
                        os.replace(f"{root}/_{self.job}/{task}/{name}", f"{root}/{name}")
                else:
                    names = [i.base_name for i in system.get_file_info(fs.FileSelector(f"{root}/_{self.job}/{task}")) if i.is_file]
                    list(pool.map(lambda k: place(names[k : k + EACH], task), range(0, len(names), EACH)))
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = located(self.folder)
        if system.get_file_info(f"{root}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.job}")


class Graymaps(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graymap"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema) -> DataSourceReader:
        given = self.options.get("filesPerPartition")
        return HeaderReader(self.options["path"], int(given or FILES), 0 if given else MANY)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() != ["name", "content"]:
            raise ValueError("graymap files are written from rows of (name, content)")
        if overwrite:
            raise ValueError("graymap files are only added")
        return FileWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Graymaps)


def byte_ranges(bands: list[int], begin: int, width: int, height: int) -> Iterator[tuple[int, int, int]]:
    """(first line, offset, bytes) of sorted bands of lines: neighbouring ones in one range, as long as it stays below RANGE bytes."""
    at = 0
    while at < len(bands):
        end = at + 1
        while end < len(bands) and bands[end] == bands[end - 1] + 1 and (bands[end] + 1 - bands[at]) * BAND * width <= RANGE:
            end += 1
        first, last = bands[at] * BAND, min((bands[end - 1] + 1) * BAND, height)
        if last > first:
            yield first, begin + first * width, (last - first) * width
        at = end


def read_lines(tiles: DataFrame, headers: DataFrame, extent: int) -> DataFrame:
    """path, level, y, row: the lines that `tiles` (path, level, y) of `extent` lines need, of the files of `headers`.

    Bands of lines are planned from the tiles; each is read once, by ranges of bytes, and the bands of a large file are dealt to several tasks.
    """
    band = F.sequence(F.floor(F.greatest("y", F.lit(0)) / BAND).cast("int"), F.floor((F.greatest("y", F.lit(0)) + extent - 1) / BAND).cast("int"))
    wanted = tiles.select("path", "level", F.explode(band).alias("band")).distinct()
    planned = wanted.join(headers.select("path", "level", "extent_x", "extent_y", "file", "begin").hint("merge"), ["path", "level"]).where(F.col("band") * BAND < F.col("extent_y"))
    dealt = planned.repartitionByRange("file", "band").sortWithinPartitions("file", "band")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                r, end = rows[at], at
                while end < len(rows) and rows[end]["file"] == r["file"] and (rows[end]["path"], rows[end]["level"]) == (r["path"], r["level"]):
                    end += 1
                system, name = located(r["file"])
                with system.open_input_file(name) as opened:
                    for first, offset, size in byte_ranges([x["band"] for x in rows[at:end]], r["begin"], r["extent_x"], r["extent_y"]):
                        data = opened.read_at(size, offset)
                        if len(data) < size:
                            raise ValueError(f"the raster is cut short: {r['file']}")
                        n = size // r["extent_x"]
                        values = pa.array(memoryview(data), pa.uint8()).cast(pa.int16())
                        row = pa.ListArray.from_arrays(pa.array(range(0, size + 1, r["extent_x"]), pa.int32()), values)
                        held.append(pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), pa.array([r["level"]] * n, pa.int32()), pa.array(range(first, first + n), pa.int32()), row], names=["path", "level", "y", "row"]))
                        cells += size
                        if cells >= CELLS:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, cells = [], 0
                at = end
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return dealt.select("path", "level", "extent_x", "extent_y", "file", "begin", "band").mapInArrow(read, "path string, level int, y int, row array<smallint>")
