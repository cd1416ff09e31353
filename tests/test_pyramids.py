import io
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tilewright.operators import pyramids
from tilewright.sources import tiffs

ROWS = "mask_path string, y int, mpp_x double, mpp_y double, row array<smallint>"


def coarser(lines):
    """Loops over pixels: the greatest of each two by two."""
    tall, wide = len(lines), len(lines[0])
    return [[max(lines[v][u] for v in (2 * y, 2 * y + 1) for u in (2 * x, 2 * x + 1) if v < tall and u < wide) for x in range(-(-wide // 2))] for y in range(-(-tall // 2))]


@pytest.fixture(scope="module")
def masks():
    rng = random.Random(5)
    found = {}
    for name, (tall, wide) in {"one.tiff": (3, 7), "edge.tiff": (16, 16), "wide.tiff": (9, 70), "tall.tiff": (65, 17), "dotted.a.tiff": (40, 33)}.items():
        found[f"/m/{name}"] = [[rng.choice([0, 0, 0, 7, 255]) for _ in range(wide)] for _ in range(tall)]
    for y in range(16, 32):
        found["/m/tall.tiff"][y] = [0] * 17  # lines of a whole tile that aren't given
    return found


@pytest.fixture(scope="module")
def written(spark, masks, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pyramids"))
    rows = [(m, y, 0.5, 0.2425, row) for m, lines in masks.items() for y, row in enumerate(lines) if any(row) or not 16 <= y < 32]
    rows += rows[:3] + [(None, 0, 1.0, 1.0, [1]), ("/m/none.tiff", 0, 1.0, 1.0, []), ("/m/null.tiff", 0, 1.0, 1.0, None)]
    assert pyramids.write_pyramids(spark.createDataFrame(rows, ROWS).repartition(3), folder, side=16) == 4
    return folder


def test_files_against_loops(spark, masks, written):
    levels = spark.read.format("tiles").load(written)
    assert sorted(os.listdir(written)) == sorted(m[3:] for m in masks)
    wanted = levels.select("path", "level", "side", F.explode(F.sequence(F.lit(0), F.size("offsets") - 1)).alias("i"), F.ceil(F.col("extent_x") / 16).alias("n")).select("path", "level", F.expr("i div n").cast("int").alias("tile_y"), (F.col("i") % F.col("n")).cast("int").alias("tile_x"))
    got = {}
    for r in tiffs.read_tiles(wanted, levels).collect():
        got.setdefault((os.path.basename(r.path), r.level), {}).setdefault(r.y, {})[r.x] = r.row
    sizes = {(os.path.basename(r.path), r.level): (r.mpp_x, r.mpp_y, r.extent_x, r.extent_y) for r in levels.collect()}
    expected = {}
    for m, lines in masks.items():
        level = 0
        while True:
            expected[m[3:], level] = lines
            if max(len(lines), len(lines[0])) <= 16:
                break
            lines, level = coarser(lines), level + 1
    assert set(got) == set(expected) == set(sizes)
    for key, lines in expected.items():
        assert [sum((got[key][y][x] for x in sorted(got[key][y])), []) for y in range(len(lines))] == lines, key
        assert sizes[key] == (0.5 * 2 ** key[1], 0.2425 * 2 ** key[1], len(lines[0]), len(lines))


def test_the_format_by_hand(masks, written):
    """Fields of one file, walked without the library's own reader."""
    with open(f"{written}/wide.tiff", "rb") as f:
        data = f.read()
    assert data[:8] == b"II+\0\x08\0\0\0"
    at, shapes = struct.unpack_from("<Q", data, 8)[0], []
    end = 0
    while at:
        tags = {}
        for k in range(struct.unpack_from("<Q", data, at)[0]):
            tag, kind, n = struct.unpack_from("<HHQ", data, at + 8 + 20 * k)
            tags[tag] = (kind, n, at + 20 + 20 * k)
        assert list(tags) == sorted(tags)
        value = lambda tag: struct.unpack_from({3: "<H", 4: "<I", 16: "<Q"}[tags[tag][0]], data, tags[tag][2])[0]  # noqa: B023, E731
        shapes.append((value(256), value(257), value(254), tags[324][1]))
        n = tags[324][1]
        offsets, counts = (struct.unpack_from(f"<{n}Q", data, value(tag) if n > 1 else tags[tag][2]) for tag in (324, 325))
        for o, c in zip(offsets, counts, strict=True):
            assert len(zlib.decompress(data[o : o + c])) == 256 and (not end or o == end)
            end = o + c
        ppcm = struct.unpack_from("<II", data, tags[282][2])
        assert abs(10_000 / (ppcm[0] / ppcm[1]) - 0.5 * 2 ** (len(shapes) - 1)) < 1e-9 and value(296) == 3
        at = struct.unpack_from("<Q", data, at + 8 + 20 * len(tags))[0]
    assert shapes == [(70, 9, 0, 5), (35, 5, 1, 3), (18, 3, 1, 2), (9, 2, 1, 1)] and end == len(data)


def test_a_region_reads_its_tiles_alone(spark, written):
    levels = spark.read.format("tiles").load(written).where(F.col("path").endswith("/wide.tiff"))
    regions = levels.where("level = 0").select("path", "level", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("width")) for x, w in ((-5, 6), (15, 2), (64, 100), (70, 5), (3, 0))])).alias("r")).select("path", "level", "r.*", F.lit(2).alias("y"), F.lit(3).alias("height"))
    met = tiffs.region_tiles(regions, levels)
    assert sorted((r.tile_y, r.tile_x) for r in met.collect()) == [(0, 0), (0, 1), (0, 4)]
    assert sorted({(r.x, len(r.row)) for r in tiffs.read_tiles(met, levels).collect()}) == [(0, 16), (16, 16), (64, 6)]
    beyond = met.select("path", "level", F.lit(0).alias("tile_y"), F.lit(5).alias("tile_x"))
    assert tiffs.read_tiles(beyond, levels).count() == 0
    rows = [{"file": "f", "offset": o, "size": 10} for o in (0, 10, 30, 40, 50)] + [{"file": "g", "offset": 60, "size": 10}]
    assert list(tiffs.spans(rows)) == [(0, 2), (2, 5), (5, 6)]


def test_headers_are_read_by_ranges():
    """What is read of a file is its header, whatever its tiles weigh."""
    head = tiffs.header([(1000, 500, 0.5, None, [10**7] * 8), (500, 250, 1.0, None, [5] * 2)], 256)

    class Opened(io.BytesIO):
        taken = 0

        def read_at(self, n, at):
            self.taken += n
            self.seek(at)
            return self.read(n)

    opened = Opened(head)
    first, second = tiffs.read_levels(tiffs.buffered(opened))
    assert first[tiffs.OFFSETS] == [len(head) + k * 10**7 for k in range(8)] and second[tiffs.OFFSETS] == [len(head) + 8 * 10**7, len(head) + 8 * 10**7 + 5]
    assert opened.taken <= tiffs.FIRST_BYTES and tiffs.Y_RESOLUTION not in first and first[tiffs.WIDTH] == [1000]
    for bad in (b"", b"MM\0+", b"II*\0" + bytes(12), head[:60]):
        with pytest.raises((ValueError, struct.error)):
            list(tiffs.read_levels(tiffs.buffered(Opened(bad))))


def test_odd_masks(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    assert pyramids.write_pyramids(none, str(tmp_path / "none")) == 0
    twice = spark.createDataFrame([("/a/m.tiff", 0, 1.0, 1.0, [1]), ("/b/m.tiff", 0, 1.0, 1.0, [1])], ROWS)
    with pytest.raises(ValueError, match="one name"):
        pyramids.write_pyramids(twice, str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="multiple"):
        pyramids.write_pyramids(none, str(tmp_path / "side"), side=20)
    bare = spark.createDataFrame([("m.tiff", 2, None, None, [5])], ROWS)
    pyramids.write_pyramids(bare, str(tmp_path / "bare"), side=16)
    row = spark.read.format("tiles").load(str(tmp_path / "bare")).first()
    assert (row.level, row.mpp_x, row.extent_x, row.extent_y) == (0, None, 1, 3)


def test_torn_files_leave_nothing(spark, tmp_path):
    tiffs.register(spark)
    parts = spark.range(3).select(F.lit("a.tiff").alias("name"), F.lit(0).alias("level"), F.col("id").cast("int").alias("tile_y"), F.lit(0).alias("tile_x"), F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        parts.coalesce(1).write.format("tiles").mode("append").save(str(tmp_path / "t"))
    assert not list((tmp_path / "t").glob("*.tiff"))
