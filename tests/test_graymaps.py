import io

import pytest
from pyspark.sql import functions as F

from tilewright.operators import pixels
from tilewright.sources import graymaps


def graymap(width, height, notes=""):
    return f"P5\n# {notes}\n{width} {height}\n255\n".encode() + bytes((x * 7 + y * 3) % 251 for y in range(height) for x in range(width))


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_header_bytes_dont_grow_with_the_file():
    for side in (10, 100, 3000):
        opened = Counting(graymap(side, side, "slide=/s/a level=1"))
        assert graymaps.read_header(opened) == (side, side, len(graymap(side, side, "slide=/s/a level=1")) - side * side, {"slide": "/s/a", "level": "1"})
        assert opened.taken <= graymaps.FIRST
    long = Counting(graymap(2000, 2000, "n=" + "x" * 6000))
    assert graymaps.read_header(long)[:2] == (2000, 2000) and long.taken <= 4 * graymaps.FIRST
    for bad in (b"", b"P5\n2", b"P2 1 1 255 0", b"P5\n#" + b"x" * (1 << 17)):
        with pytest.raises(ValueError):
            graymaps.read_header(Counting(bad))


@pytest.fixture
def slides(spark, tmp_path):
    graymaps.register(spark)
    rows = [(f"{k}.pgm", bytearray(graymap(30 + k, 200 + k, f"slide=/s/{k} level={k % 2} mpp_x=0.5 mpp_y=0.25"))) for k in range(7)]
    spark.createDataFrame(rows, "name string, content binary").repartition(3).write.format("graymap").mode("append").save(str(tmp_path / "s"))
    return spark.read.format("graymap").option("filesPerPartition", 2).load(str(tmp_path / "s"))


def test_source_plans_partitions_and_takes_filters(spark, slides, tmp_path):
    assert slides.rdd.getNumPartitions() == 4
    got = {r.path: (r.level, r.mpp_x, r.mpp_y, r.extent_x, r.extent_y) for r in slides.collect()}
    assert got == {f"/s/{k}": (k % 2, 0.5, 0.25, 30 + k, 200 + k) for k in range(7)}
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == [f"{k}.pgm" for k in range(7)]  # nothing of the writer's own folder stays
    reader = graymaps.HeaderReader(str(tmp_path / "s"), 100)
    left = list(reader.pushFilters([graymaps.EqualTo(("file",), str(tmp_path / "s" / "3.pgm")), graymaps.EqualTo(("level",), 1)]))
    assert len(left) == 1 and [len(p.names) for p in reader.partitions()] == [1]
    assert [r[0] for r in reader.read(reader.partitions()[0])] == ["/s/3"]


def test_torn_writes_leave_nothing(spark, tmp_path):
    graymaps.register(spark)
    broken = spark.range(4).select(F.concat(F.col("id").cast("string"), F.lit(".pgm")).alias("name"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"P5 1 1 255 0")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("graymap").mode("append").save(str(tmp_path / "t"))
    assert not (tmp_path / "t").exists() or list((tmp_path / "t").glob("*.pgm")) == []
    with pytest.raises(Exception, match="name, content"):
        spark.range(1).write.format("graymap").mode("append").save(str(tmp_path / "t"))


def test_regions_by_byte_ranges(spark, slides):
    tiles = slides.select("path", "level", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 20) for y in (0, 50, 60, 190)])).alias("p")).select("path", "level", "p.*")
    lines = graymaps.read_lines(tiles, slides, 20)
    seen = sorted((r.path, r.y) for r in lines.select("path", "y").collect())
    assert len(seen) == len(set(seen))  # each line once
    assert {y for p, y in seen if p == "/s/0"} == {*range(0, 128), *range(128, 200)} and {y for p, y in seen if p == "/s/5"} == set(range(205))
    for r in pixels.tile_pixels(tiles, lines, 20).collect():
        k = int(r.path[3:])
        assert r.pixels == [((r.x + i) * 7 + (r.y + j) * 3) % 251 if r.x + i < 30 + k and r.y + j < 200 + k else 0 for j in range(20) for i in range(20)]


def test_neighbouring_bands_are_one_range(monkeypatch):
    assert list(graymaps.byte_ranges([0, 1, 2, 5], 10, 100, 350)) == [(0, 10, 19200), (320, 32010, 3000)]
    monkeypatch.setattr(graymaps, "RANGE", 2 * graymaps.BAND * 100)
    assert [r[0] for r in graymaps.byte_ranges([0, 1, 2, 5], 10, 100, 350)] == [0, 128, 320]
    assert list(graymaps.byte_ranges([9], 10, 100, 350)) == []


def test_missing_lines_are_filled(spark):
    rasters = spark.createDataFrame([("p", 0, y, [y, y + 1]) for y in (0, 1, 3, 4)] + [("q", 0, y, [y]) for y in (2, 3)], "path string, level int, y int, row array<smallint>")
    tiles = spark.createDataFrame([("p", 0, 0, 0), ("p", 0, 0, 3), ("q", 0, 0, 0), ("q", 0, 0, 9)], "path string, level int, x int, y int")
    got = {(r.path, r.y): r.pixels for r in pixels.tile_pixels(tiles, rasters, 4, fill=9).collect()}
    assert got == {("p", 0): [0, 1, 9, 9, 1, 2, 9, 9, 9, 9, 9, 9, 3, 4, 9, 9], ("p", 3): [3, 4, 9, 9, 4, 5, 9, 9, *[9] * 8], ("q", 0): [*[9] * 8, 2, 9, 9, 9, 3, 9, 9, 9], ("q", 9): [9] * 16}
