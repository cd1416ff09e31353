"""Many small files: one batch of lines for many files, names without their folder, headers read once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.plans import queries
from tilewright.sources import graymaps

SF = "/root/testdata/sf0.001"


@pytest.fixture
def slides(spark, tmp_path):
    graymaps.register(spark)
    rows = [(f"{k:03d}.pgm", bytearray(b"P5\n# slide=/s/%d\n3 2\n255\n" % k + bytes([k, 1, 2, 3, 4, 5]))) for k in range(60)]
    spark.createDataFrame(rows, "name string, content binary").repartition(3).write.format("graymap").mode("append").save(str(tmp_path / "s"))
    return spark.read.format("graymap").load(str(tmp_path / "s"))


def test_lines_of_many_files_are_handed_on_together(spark, slides):
    tiles = slides.select("path", "level", F.lit(0).alias("y"))
    lines = graymaps.read_lines(tiles, slides, 2)
    assert sorted((r.path, r.y, r.row) for r in lines.collect()) == sorted((f"/s/{k}", y, [k, 1, 2] if y == 0 else [3, 4, 5]) for k in range(60) for y in range(2))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    batches = lines.mapInArrow(sizes, "n bigint").collect()
    assert sum(r.n for r in batches) == 120 and len(batches) <= 2 * lines.rdd.getNumPartitions()
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_partitions_name_their_folder_once(spark, slides, tmp_path):
    parts = graymaps.HeaderReader(str(tmp_path / "s"), 25).partitions()
    assert [len(p.names) for p in parts] == [25, 25, 10] and all(str(tmp_path) not in n for p in parts for n in p.names)
    assert sorted(r[6] for p in parts for r in graymaps.HeaderReader("", 1).read(p)) == [str(tmp_path / "s" / f"{k:03d}.pgm") for k in range(60)]


def test_moves_where_each_is_a_call(tmp_path, monkeypatch):
    class Remote:
        """A file system that isn't known as a local one."""

        def __getattr__(self, name):
            return getattr(graymaps.fs.LocalFileSystem(), name)

    monkeypatch.setattr(graymaps, "located", lambda uri: (Remote(), uri))
    monkeypatch.setattr(graymaps, "EACH", 4)
    writer = graymaps.FileWriter(str(tmp_path / "r"))
    messages = [writer.write(iter([(f"{t}-{k}.pgm", b"x") for k in range(11)])) for t in range(2)]
    writer.commit([*messages, None])
    assert sorted(f.name for f in (tmp_path / "r").iterdir()) == sorted(f"{t}-{k}.pgm" for t in range(2) for k in range(11))


def test_headers_are_read_once(spark):
    assert "BatchScan" not in queries.tile_pixels_of_files(spark, SF)._jdf.queryExecution().executedPlan().toString().replace("BatchScan parquet", "")


def test_tasks_that_read_headers_stay_few(spark, slides, tmp_path, monkeypatch):
    sizes = lambda *how: [len(p.names) for p in graymaps.HeaderReader(str(tmp_path / "s"), *how).partitions()]
    monkeypatch.setattr(graymaps, "TASKS", 4)
    assert sizes(10, 100) == [15] * 4 and sizes(10, 12) == [12] * 5 and sizes(20, 100) == [20] * 3 and sizes(10) == [10] * 6
    assert slides.count() == 60
