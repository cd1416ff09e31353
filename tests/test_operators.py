import json
import math
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tilewright.functions.geometry import Box
from tilewright.functions.plugins import resolve
from tilewright.operators import dataset, embeddings, masks, pixels, slides, tasks, tiling
from tilewright.plans import jobs
from tilewright.sources import readers, sinks

LEVELS = [("/s/a.mrxs", 0, 0.25, 0.25, 256, 128), ("/s/a.mrxs", 1, 0.5, 0.5, 128, 64), ("/s/a.mrxs", 2, 1.0, 1.0, 64, 32), ("/s/b.mrxs", 0, 0.5, 0.5, 70, 64)]


def mask_rows(path, lines, mpp):
    return [(path, y, mpp, mpp, row) for y, row in enumerate(lines)]


@pytest.fixture
def levels(spark):
    return spark.createDataFrame(LEVELS, "path string, level int, mpp_x double, mpp_y double, extent_x int, extent_y int")


def test_level_choice_and_ties(levels):
    got = {r.path: r.level for r in slides.choose_level(levels, 0.75).collect()}
    assert got == {"/s/a.mrxs": 1, "/s/b.mrxs": 0}


def test_join_keeps_unmatched_and_multiplies(spark, levels):
    meta = spark.createDataFrame([("/s/a", "a luminal", 1.0), ("/s/a", "b luminal", 2.0), (None, "a luminal", 3.0)], "path string, type string, risk_index double")
    joined = slides.join_metadata(slides.read_slides(levels, 0.5, 64, 32), slides.slide_metadata(meta))
    assert sorted((r.path, r.type or "") for r in joined.collect()) == [("/s/a.mrxs", "a luminal"), ("/s/a.mrxs", "b luminal"), ("/s/b.mrxs", "")]
    assert len({r.id for r in slides.add_id(joined).collect()}) == 3


def test_overlap_counts_only_pixels_of_the_mask(spark):
    lines = [[0, 255, 255, 255], [0, 0, 255, 255]]
    table = spark.createDataFrame(mask_rows("m", lines, 2.0), "mask_path string, y int, mpp_x double, mpp_y double, row array<smallint>")
    tiles = spark.createDataFrame([("m", 0, 0, 1.0, 1.0), ("m", 4, 0, 1.0, 1.0), ("m", 6, 2, 1.0, 1.0), ("m", 100, 0, 1.0, 1.0), ("", 0, 0, 1.0, 1.0), ("gone", 0, 0, 1.0, 1.0), ("m", 0, 0, 1.0, 1.0)], "mask string, tile_x int, tile_y int, mpp_x double, mpp_y double")
    one = masks.Overlap("o", "mask", Box(0, 0, 4, 4), "0")
    assert masks.add_overlaps(tiles, table, [one]).columns == [*tiles.columns, "o"]
    got = sorted((r.mask, r.tile_x, r.o) for r in masks.add_overlaps(tiles, table, [one]).collect())
    assert got == [("", 0, 0.0), ("gone", 0, 0.0), ("m", 0, 0.25), ("m", 0, 0.25), ("m", 4, 0.0), ("m", 6, 0.0), ("m", 100, 0.0)]
    documented = {(r.mask, r.tile_x): r.o for r in masks.add_overlaps(tiles, table, [one], "documented").collect()}
    assert documented["m", 4] == documented["m", 6] == 1.0 and documented["m", 100] == 0.0


def test_overlap_against_counting(spark):
    """Lines of many words and bands, ragged and missing lines, and resolutions that don't divide."""
    rng = random.Random(2)
    lines = {y: [rng.choice([0, 255, 7]) for _ in range(rng.choice([0, 1, 63, 64, 65, 150, 200]))] for y in range(150) if y == 0 or rng.random() < 0.9}
    table = spark.createDataFrame([("m", y, 1.5, 1.5, row) for y, row in lines.items()], "mask_path string, y int, mpp_x double, mpp_y double, row array<smallint>")
    places = [(rng.randrange(-40, 320), rng.randrange(-40, 240)) for _ in range(60)]
    tiles = spark.createDataFrame([("m", x, y, 1.0, 1.25) for x, y in places], "mask string, tile_x int, tile_y int, mpp_x double, mpp_y double")
    for roi, value in ((Box(3, 5, 90, 120), "0"), (Box(0, 0, 1, 1), "255"), (Box(10, 0, 120, 7), "255")):
        got = masks.add_overlaps(tiles, table, [masks.Overlap("o", "mask", roi, value)], "documented").collect()
        assert len(got) == len(places)
        for r in got:
            x0, x1 = math.floor((r.tile_x + roi.x0) / 1.5), math.ceil((r.tile_x + roi.x1) / 1.5)
            y0, y1 = math.floor((r.tile_y + roi.y0) * 1.25 / 1.5), math.ceil((r.tile_y + roi.y1) * 1.25 / 1.5)
            seen = [v for y in range(y0, y1) for x, v in enumerate(lines.get(y, ())) if x0 <= x < x1]
            assert r.o == (1 - sum(v == int(value) for v in seen) / len(seen) if seen else 0.0)


def tile_table(spark, levels):
    table = slides.add_id(slides.join_metadata(slides.read_slides(levels, 0.5, 64, 32), slides.slide_metadata(spark.createDataFrame([("/s/a", "a luminal", 1.0)], "path string, type string, risk_index double"))))
    half = [[0] * 8 + [255] * 24] * 12
    lines = mask_rows("/t/a.tiff", half, 4.0) + mask_rows("/q/Piqe_piqe_median_activity_mask_a.tiff", [[255] * 6 + [0] * 26] * 12, 4.0)
    return table, spark.createDataFrame(lines, "mask_path string, y int, mpp_x double, mpp_y double, row array<smallint>")


def test_tiling_end_to_end(spark, levels):
    table, rows = tile_table(spark, levels)
    got = {(r.tile_x, r.tile_y): r for r in tiling.tile_slides(table, rows, 64, tiling.MaskRoots("/t", None, "/q")).collect()}
    # Slide a has tiles at 0, 32, 64: the centre of the first is background, of the second half, of the third none, which scores 0 here.
    assert set(got) == {(32, 0)}
    row = got[32, 0]
    assert (row.tissue_overlap, row.blur_overlap, row.folding_overlap, row.type) == (0.5, 0.75, 0.0, "a luminal")
    documented = tiling.tile_slides(table, rows, 64, tiling.MaskRoots("/t", None, "/q"), "documented")
    assert {(r.tile_x, r.tile_y) for r in documented.collect()} == {(32, 0), (64, 0)}
    assert tiling.tile_slides(table, rows, 64, tiling.MaskRoots()).count() == 0


def test_tiling_plan_has_no_python_and_no_nested_loops(spark, levels):
    table, rows = tile_table(spark, levels)
    plan = tiling.tile_slides(table, rows, 64, tiling.MaskRoots("/t", "/e", "/q"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


def test_pair_written_read_and_linked(spark, levels, tmp_path):
    table, rows = tile_table(spark, levels)
    counts = sinks.write_dataset(table, tiling.tile_slides(table, rows, 64, tiling.MaskRoots("/t", None, "/q")), str(tmp_path), "x")
    assert counts == {"slides": 2, "tiles": 1}
    s, t = readers.read_pair(spark, f"{tmp_path}/x", f"{tmp_path}/x")
    assert (s.count(), t.count()) == (4, 2)
    pair = s, t = readers.read_pair(spark, f"{tmp_path}/x")
    assert readers.read_pair(spark, f"{tmp_path}/x", pairs=[pair])[0].count() == 4 and readers.read_pair(spark, pairs=[pair])[1].count() == 1
    with pytest.raises(ValueError):
        readers.read_pair(spark)
    assert [tuple(r) for r in dataset.tile_samples(dataset.link_tiles(s, t)).select("slide_name", "x", "y").collect()] == [("a", 32, 0)]
    assert dataset.link_tiles(s, t, "left").count() == 2
    assert dataset.rename_coordinates(s).columns == s.columns


def test_jobs_tiling_then_embeddings_resume(spark, levels, tmp_path):
    (tmp_path / "map.csv").write_text("path,type,risk_index\n/s/a,a luminal,0.5\n/s/b,b luminal,\n")
    _, rows = tile_table(spark, levels)
    out = str(tmp_path / "out")
    counts = jobs.tiling_job(spark, str(tmp_path / "map.csv"), levels, rows, out, "d", 0.5, 64, 32, tiling.MaskRoots("/t", None, "/q"), "documented")
    assert counts == {"slides": 2, "tiles": 2}
    load = lambda df: df.withColumn("pixels", F.array(F.col("x").cast("float"), F.lit(1.0).cast("float")))
    emb = str(tmp_path / "emb")
    assert jobs.embeddings_job(spark, [f"{out}/d"], emb, load, embeddings.projection_encoder(4)) == 2
    first = spark.read.parquet(emb)
    assert first.count() == 2 and dict(first.dtypes)["embedding"] == "array<float>"
    assert {r.slide_name for r in first.collect()} == {"a"}
    assert jobs.embeddings_job(spark, [f"{out}/d"], emb, load, embeddings.projection_encoder(4)) == 1  # b has no tiles, so no file
    named = str(tmp_path / "named")
    assert jobs.embeddings_job(spark, [f"{out}/d"], named, load, "tilewright.operators.embeddings.small_projection", transform="numpy.negative") == 2
    assert {tuple(-v for v in r.embedding[:4]) for r in spark.read.parquet(named).collect()} == {tuple(r.embedding) for r in first.collect()}


def test_retry_outcomes(spark):
    ise, log = (500, "... Internal Server Error ..."), []
    cases = {"ok": [(200, "")], "second": [ise, (200, "")], "spent": [ise] * 12, "plain": [(500, "other")], "late": [(-1, "Timeout")], "then late": [ise, (-1, "Timeout")], "lost": [(-1, "refused")], "open": [ise]}
    for name, answers in cases.items():
        log += [(name, i, *a) for i, a in enumerate(answers, 1)]
    got = {r.wsi_path: (r.attempts, r.outcome, r.backoff_s) for r in tasks.retry_outcomes(spark.createDataFrame(log, "wsi_path string, attempt int, status int, text string")).collect()}
    assert got == {"ok": (1, "done", 0), "second": (2, "done", 2), "spent": (10, "exhausted", 2046), "plain": (1, "done", 0), "late": (1, "timeout", 0), "then late": (2, "timeout", 2), "lost": (1, "error", 0), "open": (1, "pending", 2)}


def test_calls_are_isolated(spark):
    def call(item):
        name = item["wsi_path"]
        if name == "t":
            raise TimeoutError
        if name == "e":
            raise RuntimeError("boom")
        return (500, "Internal Server Error") if name == "x" else (200, "ok")

    got = {r.wsi_path: (r.status, r.attempts, r.outcome) for r in tasks.call_all(spark.createDataFrame([(n,) for n in "aetx"], "wsi_path string"), call, 2, most=3, sleep=lambda s: None).collect()}
    assert got == {"a": (200, 1, "done"), "t": (-1, 1, "timeout"), "e": (-1, 1, "error"), "x": (500, 3, "exhausted")}


def test_calls_are_made_once(spark, tmp_path):
    def call(item):
        (tmp_path / uuid.uuid4().hex).write_text(item["wsi_path"])
        return 200, "ok"

    done = tasks.call_all(spark.createDataFrame([(n,) for n in "abc"], "wsi_path string"), call, 2)
    assert done.count() == 3 and len(done.collect()) == 3 and sorted(p.read_text() for p in tmp_path.iterdir()) == ["a", "b", "c"]


def test_a_lost_task_repeats_only_what_was_in_flight(tmp_path):
    items = [{"wsi_path": f"s{k % 5}", "_item": k % 5, "_turn": k // 5} for k in range(20)]
    calls = []

    def call(item):
        assert set(item) == {"wsi_path"}
        calls.append(item["wsi_path"])
        return 200, "ok"

    def task(call):
        return list(tasks.logged_outcomes(iter(items), tasks.OutcomeLog(str(tmp_path / "log" / "3"), 0.0), call, 3, lambda s: None, None))

    run = tasks.logged_outcomes(iter(items), tasks.OutcomeLog(str(tmp_path / "log" / "3"), 0.0), call, 3, lambda s: None, None)
    for _ in range(7):
        next(run)
    run.close()  # lost after seven
    again = []
    done = task(lambda item: again.append(item["wsi_path"]) or (200, "ok"))
    assert len(calls) == 7 and len(again) == len(done) == 13
    assert task(lambda item: again.append("more")) == [] and len(again) == 13
    assert not list((tmp_path / "log").rglob("*.part"))


def test_calls_go_on_where_a_failed_job_ended(spark, tmp_path):
    items = spark.createDataFrame([(f"s{k % 30}", k % 3) for k in range(40)] + [(None, 1)] * 2, "wsi_path string, k int").repartition(3)
    made, log = tmp_path / "made", str(tmp_path / "log")
    made.mkdir()

    def call(item, broken=True):
        if broken and item["wsi_path"] == "s7":
            import os

            os._exit(1)  # the worker is lost in the middle of a call
        (made / uuid.uuid4().hex).write_text(str(item["wsi_path"]))
        return 200, "ok"

    with pytest.raises(Exception):  # noqa: B017
        tasks.call_all(items, call, 2, log=log, flush_seconds=0.0)
    before = len(list(made.iterdir()))
    assert before < 42
    got = tasks.call_all(items, lambda item: call(item, False), 2, log=log, flush_seconds=0.0)
    assert sorted(r.wsi_path for r in got.collect()) == sorted([f"s{k % 30}" for k in range(40)] + ["<unknown>"] * 2)
    assert len(list(made.iterdir())) - 42 <= 2  # one in flight in each task at most
    assert tasks.call_all(items.limit(0), call, 2, log=log).count() == 0
    assert tasks.call_all(items.where("wsi_path = 's7'"), call, 2, log=log).count() == 2  # not called again


def test_waiting_items_let_others_pass():
    now, slept, order = [0.0], [], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    def call(item):
        order.append(item["wsi_path"])
        return (500, "Internal Server Error") if item["wsi_path"] == "x" and order.count("x") < 3 else (200, "ok")

    rows = list(tasks.outcomes(iter([{"wsi_path": n} for n in ("x", "a", "b", None)]), call, 10, sleep, 5.0, lambda: now[0]))
    assert order == ["x", "a", "b", None, "x", "x"] and slept == [2.0, 4.0]
    assert rows[-1] == ("x", 200, 3, "done", None) and rows[2][0] == "<unknown>"


def test_hung_calls_end():
    def call(item):
        time.sleep(30)

    began = time.monotonic()
    assert tasks.within(call, {}, 0.05) == (-1, "Timeout") and time.monotonic() - began < 5
    assert list(tasks.outcomes(iter([{"wsi_path": "h"}]), call, 3, time.sleep, 0.05)) == [("h", -1, 1, "timeout", "Timeout")]


def test_report_requests(spark):
    df = spark.createDataFrame([("b",), ("a",)], "wsi_path string")
    row = tasks.report_requests(df, "http://q/", "/m", "/r").first()
    assert {r.payload for r in tasks.report_requests(df, "", "/m", "/r", part=F.col("wsi_path")).collect()} == {f'{{"backgrounds":["{n}"],"mask_dir":"/m","save_location":"/r","compute_metrics":true}}' for n in "ab"}
    assert row.url == "http://q/report" and row.payload == '{"backgrounds":["a","b"],"mask_dir":"/m","save_location":"/r","compute_metrics":true}'


def test_graymaps(spark, tmp_path):
    (tmp_path / "m.pgm").write_bytes(b"P5\n# c\n3 2\n255\n" + bytes([0, 255, 0, 255, 255, 0]))
    got = sorted((r.y, r.row) for r in readers.read_masks(spark, str(tmp_path / "*.pgm"), 1.0, 1.0).collect())
    assert got == [(0, [0, 255, 0]), (1, [255, 255, 0])]
    for bad in (b"P2\n1 1\n255\n0", b"P5\n2 2\n255\n\0", b"P5\n2"):
        with pytest.raises(ValueError):
            readers.parse_pgm(bad)


def test_segmentation_and_requests_jobs(spark, levels, tmp_path):
    files = spark.createDataFrame([("/s/a.mrxs", bytearray(b"\x00\x01")), ("/s/b.mrxs", bytearray(b"\x01"))], "path string, content binary")
    jobs.tissue_masks_job(files, levels, 0, lambda c, mpp: [[255 if v and mpp < 0.4 else 0 for v in c]], str(tmp_path / "m"))
    assert sorted((r.mask_path, r.row, r.mpp_x) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("a.tiff", [0, 255], 0.25), ("b.tiff", [0], 0.5)]
    (tmp_path / "map.csv").write_text("path,type,risk_index\n/s/a,a luminal,0.5\n/s/b,b luminal,1\n")

    def call(item):
        sent = json.loads(item["payload"])
        return (200, "ok") if sent["wsi_path"] == item["wsi_path"] and sent["output_path"] == "/q" and sent["mask_level"] == 3 else (404, "no")

    def report(item):
        sent = json.loads(item["payload"])
        return (200 if item["url"] == "http://q/report" and sent["backgrounds"] == ["/s/a.mrxs", "/s/b.mrxs"] and sent["mask_dir"] == "/q" else 404), "ok"

    done, sent = jobs.quality_control_job(spark, str(tmp_path / "map.csv"), call, "/q", 3, 1, url="http://q/", report=report, save_location="/r")
    assert [r.status for r in done.collect()] == [200, 200] and [(r.status, r.wsi_path) for r in sent.collect()] == [(200, "http://q/report")]
    assert jobs.quality_control_job(spark, str(tmp_path / "map.csv"), call, "/x", 3, 1)[1] is None
    got = jobs.epithelium_masks_job(spark, str(tmp_path / "map.csv"), "/t", "/o", "m-1", lambda item: (200 if item["output_path"] == f"/o/{item['wsi_path'][3]}.tiff" and item["tissue_mask_path"] == f"/t/{item['wsi_path'][3]}.tiff" and item["model"] == "m-1" else 404, "ok"))
    assert [r.status for r in got.collect()] == [200, 200]


def test_headers_and_other_column_names(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# slide=/s/a level=2 mpp_x=0.5 mpp_y=0.25\n3 2\n255\n" + bytes(6))
    (tmp_path / "b.pgm").write_bytes(b"P5 1 1 255 " + bytes(1))
    got = sorted(tuple(r) for r in readers.read_levels(spark, str(tmp_path / "*.pgm")).collect())
    assert got[0] == ("/s/a", 2, 0.5, 0.25, 3, 2) and got[1][0].endswith("/b.pgm") and got[1][1:] == (0, None, None, 1, 1)
    (tmp_path / "map.csv").write_text("path,type,other\n007,a luminal,0.5\n")
    assert [tuple(r) for r in readers.read_mapping(spark, str(tmp_path / "map.csv"), "other").collect()] == [("007", "a luminal", 0.5)]


def test_tile_pixels_fill_beyond_the_edge(spark):
    rasters = spark.createDataFrame([("p", 0, 0, [1, 2, 3]), ("p", 0, 1, [4, 5, 6]), ("p", 1, 0, [9])], "path string, level int, y int, row array<smallint>")
    tiles = spark.createDataFrame([("p", 0, 0, 0, "a"), ("p", 0, 2, 1, "b"), ("p", 0, 7, 7, "c"), ("p", 0, 0, 0, "d")], "path string, level int, x int, y int, tag string")
    got = {r.tag: r.pixels for r in pixels.tile_pixels(tiles, rasters, 2, fill=0).collect()}
    assert got == {"a": [1, 2, 4, 5], "b": [6, 0, 0, 0], "c": [0, 0, 0, 0], "d": [1, 2, 4, 5]}


def test_segments_and_plugins():
    assert pixels.dark_tissue(100)(b"P5 2 1 255 " + bytes([10, 200])) == [[255, 0]]
    assert resolve("tilewright.operators.pixels.dark_tissue") is pixels.dark_tissue
    for bad, error in (("dark_tissue", ValueError), ("tilewright.operators.pixels.missing", AttributeError), ("tilewright.operators.tasks.MOST", TypeError)):
        with pytest.raises(error):
            resolve(bad)
