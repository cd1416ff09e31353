"""Named queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry, labels, paths, vectors
from tilewright.functions.overlap import overlap_score, positive
from tilewright.operators import blocks, dataset, embeddings, encoder, grid, pixels, pyramids, segmentation, slides, tasks, tiling
from tilewright.sources import graymaps, readers, schemas, sinks, tiffs
from tilewright.sources.scratch import fresh_folder, stored

from . import fixtures as fx
from . import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {fx.SQL} {sql}"
        return fn

    return register


@query("SELECT path || '.mrxs' AS slide_path, type, risk_index FROM mapping")
def mapping_paths(spark, sf_dir):
    return slides.slide_metadata(fx.mapping(spark, sf_dir))


@query("SELECT path, regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1') AS stem, regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1') || '.tiff' AS mask_name, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1'), '^(.+)\\.[^.]+$', '\\1') AS key FROM base")
def path_stem_suffix(spark, sf_dir):
    p = F.col("path")
    return fx.base_slides(spark, sf_dir).select("path", paths.stem(p).alias("stem"), paths.with_suffix_name(p).alias("mask_name"), paths.embedding_key(p, "reference").alias("key"))


_FILE = "replace(path[4:], '.mrxs', '.tiff')"


@query(f"SELECT path, '/m/tissue/' || {_FILE} AS tissue, '/m/qc/Piqe_piqe_median_activity_mask_' || {_FILE} AS blur, '/m/qc/FoldingFunction_folding_test_' || {_FILE} AS folding, '/m/qc/ResidualArtifactsAndCoverage_coverage_mask_' || {_FILE} AS residual FROM base")
def mask_paths(spark, sf_dir):
    p = F.col("path")
    return fx.base_slides(spark, sf_dir).select("path", paths.mask_path(p, "/m/tissue").alias("tissue"), *[paths.qc_mask_path(p, "/m/qc/", kind).alias(kind) for kind in paths.QC_PREFIXES])


@query("SELECT path, '' AS tissue, '' AS blur FROM base")
def mask_paths_disabled(spark, sf_dir):
    return fx.base_slides(spark, sf_dir).select("path", paths.mask_path(F.col("path"), None).alias("tissue"), paths.qc_mask_path(F.col("path"), None, "blur").alias("blur"))


@query("SELECT path, type, risk_index FROM base LEFT JOIN meta ON path = slide_path")
def slide_metadata_left_join(spark, sf_dir):
    meta = slides.slide_metadata(fx.mapping(spark, sf_dir).where("k % 3 <> 0"))
    return slides.join_metadata(fx.base_slides(spark, sf_dir), meta).select("path", "type", "risk_index")


@query("SELECT b.path, m.type, m.risk_index FROM base b LEFT JOIN (SELECT * FROM meta UNION ALL SELECT * FROM meta) m ON b.path = m.slide_path")
def slide_metadata_join_duplicates(spark, sf_dir):
    meta = slides.slide_metadata(fx.mapping(spark, sf_dir).where("k % 3 <> 0"))
    return slides.join_metadata(fx.base_slides(spark, sf_dir), meta.union(meta)).select("path", "type", "risk_index")


@query("SELECT path, id FROM slides")
def slide_row_hash(spark, sf_dir):
    return fx.slides(spark, sf_dir).select("path", "id")


def _levels(spark, sf_dir):
    level = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level")
    s = fx.base_slides(spark, sf_dir).select("path", "k", "extent_x", "extent_y", level)
    mpp = (F.lit(0.25) + F.col("k") % 3 * 0.125) * F.pow(F.lit(2.0), F.col("level"))
    return s.select("path", "level", mpp.alias("mpp_x"), mpp.alias("mpp_y"), *[F.floor(F.col(f"extent_{a}") / F.pow(F.lit(2.0), F.col("level"))).cast("int").alias(f"extent_{a}") for a in "xy"])


@query("SELECT path, level, mpp_x, mpp_y, extent_x, extent_y FROM (SELECT path, l::INTEGER AS level, (0.25::DOUBLE + k % 3 * 0.125::DOUBLE) * 2.0::DOUBLE ** l AS mpp_x, (0.25::DOUBLE + k % 3 * 0.125::DOUBLE) * 2.0::DOUBLE ** l AS mpp_y, (extent_x // (2 ** l)::INTEGER)::INTEGER AS extent_x, (extent_y // (2 ** l)::INTEGER)::INTEGER AS extent_y FROM base, unnest(range(0, 4)) AS t(l)) QUALIFY row_number() OVER (PARTITION BY path ORDER BY abs(mpp_x - 0.97), level) = 1")
def level_choice(spark, sf_dir):
    return slides.choose_level(_levels(spark, sf_dir), 0.97)


def _grid(last):
    def run(spark, sf_dir):
        return grid.grid_tiles(fx.base_slides(spark, sf_dir), last).select("path", "tile_x", "tile_y")

    return run


query("SELECT path, tile_x, tile_y FROM tiles", "grid_keep")(_grid("keep"))
_COUNT = "(SELECT path, extent_x, extent_y, {x} AS nx, {y} AS ny FROM base) c, unnest(range(0, nx)) AS a(ix), unnest(range(0, ny)) AS b(iy)"
query("SELECT path, (ix * 32)::INTEGER AS tile_x, (iy * 32)::INTEGER AS tile_y FROM " + _COUNT.format(x="greatest(0, floor((extent_x - 64) / 32)::INTEGER + 1)", y="greatest(0, floor((extent_y - 64) / 32)::INTEGER + 1)"), "grid_drop")(_grid("drop"))
query("SELECT path, greatest(0, least(ix * 32, extent_x - 64))::INTEGER AS tile_x, greatest(0, least(iy * 32, extent_y - 64))::INTEGER AS tile_y FROM " + _COUNT.format(x="greatest(1, ceil((extent_x - 64) / 32)::INTEGER + 1)", y="greatest(1, ceil((extent_y - 64) / 32)::INTEGER + 1)"), "grid_shift")(_grid("shift"))


@query("SELECT path, tile_x, tile_y FROM tiles WHERE extent_x <= 64 OR extent_y <= 64")
def grid_small_slide(spark, sf_dir):
    return grid.grid_tiles(fx.base_slides(spark, sf_dir).where("extent_x <= 64 OR extent_y <= 64")).select("path", "tile_x", "tile_y")


@query("SELECT t AS tile, (t // 4)::INTEGER AS x0, (t // 4 + t // 2)::INTEGER AS x1 FROM (VALUES (64), (224), (225), (226), (512)) AS v(t)")
def roi_bounds(spark, sf_dir):
    rows = [(t, geometry.center_roi(t).x0, geometry.center_roi(t).x1) for t in (64, 224, 225, 226, 512)]
    return spark.createDataFrame(rows, "tile int, x0 int, x1 int")


def _tiles(spark, sf_dir):
    return tiling.expand(fx.slides(spark, sf_dir), fx.ROOTS)


def _overlap(which):
    def run(spark, sf_dir):
        one = tiling.overlaps(fx.TILE)[which]
        kind = one.path_column.removesuffix("_mask_path")
        return tiling.score_tiles(fx.slides(spark, sf_dir), fx.masks(spark, sf_dir, (kind,)), [one], fx.ROOTS).select("slide_id", "tile_x", "tile_y", one.column)

    return run


for _i, (_column, _, _center, _) in enumerate(tiling.OVERLAPS):
    _name = f"overlap_{'center' if _center else 'full'}_{_column.removesuffix('_overlap')}"
    query(f"SELECT id AS slide_id, tile_x, tile_y, {_column} FROM tiles JOIN scores USING (k, tile_x, tile_y)", _name)(_overlap(_i))

_EDGES = [(1, None), (2, {}), (3, {"0": None}), (4, {"0": 0.0}), (5, {"0": 0.25}), (6, {"0": 1.0}), (7, {"255": 1.0}), (8, {"0": float("nan")})]


@query("SELECT * FROM (VALUES (1, 0.0::DOUBLE, 0.0::DOUBLE, false), (2, 0.0, 1.0, false), (3, 0.0, 1.0, false), (4, 0.0, 1.0, false), (5, 0.75, 0.75, true), (6, 0.0, 0.0, false), (7, 0.0, 1.0, false), (8, 'nan'::DOUBLE, 'nan'::DOUBLE, false)) AS t(n, reference, documented, kept)")
def overlap_edge_cases(spark, sf_dir):
    df = spark.createDataFrame(_EDGES, "n int, m map<string,double>")
    ours = overlap_score(F.col("m"), "0")
    return df.select("n", ours.alias("reference"), overlap_score(F.col("m"), "0", "documented").alias("documented"), positive(ours).alias("kept"))


@query("SELECT id AS slide_id, tile_x, tile_y, tissue_overlap FROM tiles JOIN scores USING (k, tile_x, tile_y) WHERE tissue_overlap > 0")
def tissue_filter(spark, sf_dir):
    return _overlap(0)(spark, sf_dir).where(positive(F.col("tissue_overlap")))


@query("SELECT tile_x, tile_y, id AS slide_id, type, risk_index, tissue_overlap, blur_overlap, folding_overlap, residual_overlap, epithelium_overlap FROM tiles JOIN scores USING (k, tile_x, tile_y) WHERE tissue_overlap > 0")
def tiling_pipeline(spark, sf_dir):
    return tiling.tile_slides(fx.slides(spark, sf_dir), fx.masks(spark, sf_dir), fx.TILE, fx.ROOTS)


@query("SELECT (SELECT count(*) FROM slides)::BIGINT AS n_slides, (SELECT count(*) FROM tiles JOIN scores USING (k, tile_x, tile_y) WHERE tissue_overlap > 0)::BIGINT AS n_tiles FROM (SELECT 1)")
def tiling_counts(spark, sf_dir):
    ones = lambda df, s, t: df.select(F.lit(s).alias("s"), F.lit(t).alias("t"))
    both = ones(fx.slides(spark, sf_dir), 1, 0).union(ones(tiling_pipeline(spark, sf_dir), 0, 1))
    return both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n_slides"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tiles"))


@query("SELECT path, (type = 'a luminal')::BIGINT AS label, regexp_replace(path, '^.*/(.+)\\.[^.]+$', '\\1') AS name FROM mapping")
def label_type(spark, sf_dir):
    return labels.process_slides(fx.mapping(spark, sf_dir), "type").select("path", labels.label_value("type").alias("label"), "name")


@query("SELECT path, risk_index AS index FROM mapping")
def label_index_f64(spark, sf_dir):
    return labels.process_slides(fx.mapping(spark, sf_dir), "index", "risk_index").select("path", "index")


@query("SELECT path, risk_index::FLOAT AS label FROM mapping")
def label_index_f32(spark, sf_dir):
    return labels.process_slides(fx.mapping(spark, sf_dir), "index", "risk_index").select("path", labels.label_value("index").alias("label"))


@query("SELECT id AS slide_id, tile_x AS x, tile_y AS y FROM tiles")
def rename_xy(spark, sf_dir):
    return dataset.rename_coordinates(_tiles(spark, sf_dir).select("slide_id", "tile_x", "tile_y"))


@query("SELECT replace(path[4:], '.mrxs', '') AS slide_name, id AS slide_id, tile_x AS x, tile_y AS y FROM tiles")
def tile_samples(spark, sf_dir):
    return dataset.tile_samples(dataset.link_tiles(fx.slides(spark, sf_dir), _tiles(spark, sf_dir).select("slide_id", "tile_x", "tile_y")))


@query("SELECT path, count(*)::BIGINT AS n_tiles FROM tiles GROUP BY path")
def tiles_by_slide(spark, sf_dir):
    linked = dataset.link_tiles(fx.slides(spark, sf_dir), _tiles(spark, sf_dir).select("slide_id", "tile_x", "tile_y"))
    return linked.groupBy("path").agg(F.count("*").alias("n_tiles"))


@query("SELECT path, id FROM slides WHERE k % 2 = 0 UNION ALL SELECT path, id FROM slides WHERE k % 2 <> 0")
def multi_source_union(spark, sf_dir):
    """One source is read from its folder, the other is a pair already loaded."""
    s, folder = fx.slides(spark, sf_dir), fresh_folder(spark, "union")
    none = spark.createDataFrame([], "slide_id string")
    sinks.write_dataset(s.where("k % 2 = 0").select("path", "id"), none, folder, "even")
    return readers.read_pair(spark, f"{folder}/even", pairs=[(s.where("k % 2 <> 0").select("id", "path"), none)])[0]


_EMBED = "SELECT vec_id, {x} FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)"


@query(_EMBED.format(x="list_transform(e, lambda v, i: (v / 255.0::DOUBLE - [0.485::DOUBLE, 0.456::DOUBLE, 0.406::DOUBLE][(i - 1) % 3 + 1]) / [0.229::DOUBLE, 0.224::DOUBLE, 0.225::DOUBLE][(i - 1) % 3 + 1]) AS pixels"))
def normalize_channels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vectors.normalize_channels(F.col("embedding")).alias("pixels"))


@query(_EMBED.format(x="list_concat(e[1:8], list_transform(range(1, 9), lambda d: (0.0::DOUBLE + e[40 + d] + e[48 + d] + e[56 + d]) / 3)) AS pooled"))
def cls_meanpool(spark, sf_dir):
    tokens = vectors.in_tokens(F.col("embedding"), 8)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vectors.class_and_mean(tokens).alias("pooled"))


@query("SELECT (vec_id % 7)::VARCHAR AS slide_name, (vec_id * 32)::INTEGER AS x, (label * 32)::INTEGER AS y, embedding FROM embeddings")
def embedding_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select((F.col("vec_id") % 7).cast("string").alias("slide_name"), (F.col("vec_id") * 32).cast("int").alias("x"), (F.col("label") * 32).cast("int").alias("y"), F.col("embedding").cast("array<float>").alias("embedding"))


def _pending(mode, written="k % 5 = 0"):
    def run(spark, sf_dir):
        s = fx.base_slides(spark, sf_dir)
        done = s.where(written).select(paths.embedding_key(F.col("path"), mode).alias("key"))
        return embeddings.pending(s, done, mode).select("path", "key")

    return run


query("SELECT path, replace(path[4:], '.mrxs', '') AS key FROM base WHERE k % 5 <> 0", "embed_pending")(_pending("full"))
query("SELECT path, split_part(path[4:], '.', 1) AS key FROM base WHERE split_part(path[4:], '.', 1) NOT IN (SELECT split_part(path[4:], '.', 1) FROM base WHERE k % 5 = 0 AND path LIKE '/d/Brand#1%')", "embed_pending_reference")(_pending("reference", "k % 5 = 0 AND path LIKE '/d/Brand#1%'"))


@query("SELECT path AS wsi_path, '/out' AS output_path, 3::BIGINT AS mask_level, 1::BIGINT AS sample_level, true AS check_residual, false AS check_folding, true AS check_blur FROM base")
def qc_payload(spark, sf_dir):
    body = tasks.qc_payload(F.col("path"), "/out", 3, 1, folding=False)
    read = F.from_json(body, "wsi_path string, output_path string, mask_level bigint, sample_level bigint, check_residual boolean, check_folding boolean, check_blur boolean")
    return fx.base_slides(spark, sf_dir).select(read.alias("p")).select("p.*")


@query("""
WITH a AS (SELECT '/d/' || user_id AS wsi_path, event_id, CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'view' AND user_id % 5 = 0 THEN -1 ELSE 200 END AS status FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY wsi_path ORDER BY event_id) AS n FROM a QUALIFY n <= 10),
e AS (SELECT wsi_path, min(CASE WHEN status <> 500 THEN n END) AS stop, max(n) AS m FROM n GROUP BY wsi_path)
SELECT e.wsi_path, coalesce(stop, m)::INTEGER AS attempts, n.status::INTEGER AS status, CASE WHEN stop IS NULL THEN CASE WHEN m >= 10 THEN 'exhausted' ELSE 'pending' END WHEN n.status = -1 THEN 'timeout' ELSE 'done' END AS outcome,
(2 ** (coalesce(stop - 1, m) + 1) - 2)::BIGINT AS backoff_s FROM e JOIN n ON n.wsi_path = e.wsi_path AND n.n = coalesce(stop, m)""")
def qc_retry_outcome(spark, sf_dir):
    return tasks.retry_outcomes(fx.attempts(spark, sf_dir))


@query("""SELECT slide_id, x, y, list_sum(pixels)::BIGINT AS total, pixels[1]::BIGINT AS first_pixel, pixels[28]::BIGINT AS middle_pixel FROM (
SELECT id AS slide_id, tile_x // 32 AS x, tile_y // 32 AS y, list(CASE WHEN tile_y // 32 + dy > extent_y // 8 + 16 OR tile_x // 32 + dx > extent_x // 8 + 16 THEN 0 WHEN ((tile_x // 32 + dx) * 31 + (tile_y // 32 + dy) * 17 + k * 7) % 11 < k % 11 THEN 0 ELSE 255 END ORDER BY dy, dx) AS pixels
FROM tiles, unnest(range(0, 8)) AS u(dx), unnest(range(0, 8)) AS v(dy) GROUP BY ALL)""")
def tile_pixels(spark, sf_dir):
    rasters = fx.masks(spark, sf_dir).where("mask_path LIKE '/m/tissue/%'").select(F.col("mask_path").alias("path"), F.lit(0).alias("level"), "y", "row")
    tiles = _tiles(spark, sf_dir).select("slide_id", F.col("tissue_mask_path").alias("path"), F.lit(0).alias("level"), (F.col("tile_x") / 32).cast("int").alias("x"), (F.col("tile_y") / 32).cast("int").alias("y"))
    found = pixels.tile_pixels(tiles, rasters, 8)
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return found.select("slide_id", "x", "y", total.alias("total"), F.get("pixels", F.lit(0)).cast("bigint").alias("first_pixel"), F.get("pixels", F.lit(27)).cast("bigint").alias("middle_pixel"))


@query("""SELECT CASE WHEN k % 7 = 0 THEN '<unknown>' ELSE path END AS wsi_path, ([200, 500, 404, -1])[k % 4 + 1]::INTEGER AS status, (CASE WHEN k % 4 = 1 THEN 3 ELSE 1 END)::INTEGER AS attempts,
([ 'done', 'exhausted', 'done', 'error'])[k % 4 + 1] AS outcome, ([NULL, 'Internal Server Error', NULL, 'no such slide'])[k % 4 + 1] AS error FROM base""")
def bounded_map_outcomes(spark, sf_dir):
    def call(item):
        k = item["k"] % 4
        if k == 3:
            raise ValueError("no such slide")
        return ((200, "ok"), (500, "Internal Server Error"), (404, "missing"))[k]

    named = F.when(F.col("k") % 7 != 0, F.col("path"))
    return tasks.call_all(fx.base_slides(spark, sf_dir).select(named.alias("wsi_path"), "k"), call, 4, most=3, sleep=lambda seconds: None)


@query("""SELECT slide_name, x, y, list_transform(range(0, 16), lambda j: list_sum(list_transform(range(0, len(q)), lambda i: q[i + 1] * ((7 * i + 13 * j) % 11 - 5)))::FLOAT) AS embedding FROM (
SELECT (vec_id % 7)::VARCHAR AS slide_name, (vec_id * 32)::INTEGER AS x, (label * 32)::INTEGER AS y, list_transform(embedding, lambda v: floor(v * 16)::BIGINT) AS q FROM embeddings)""")
def encoder_stub(spark, sf_dir):
    """Whole numbers go in, so that sums don't depend on their order."""
    pixels = F.transform("embedding", lambda v: F.floor(v * 16).cast("float"))
    return embeddings.encode(embedding_rows(spark, sf_dir).withColumn("pixels", pixels), "tilewright.operators.embeddings.small_projection")


@query("""WITH q AS (SELECT (vec_id % 7)::VARCHAR AS slide_name, (vec_id * 32)::INTEGER AS x, (label * 32)::INTEGER AS y, list_transform(embedding, lambda v: floor(v * 16)) AS q FROM embeddings),
t AS (SELECT slide_name, x, y, list_transform(range(0, len(q) // 8), lambda p: list_transform(range(0, 8), lambda j: list_sum(list_transform(range(0, 8), lambda i: q[8 * p + i + 1] * ((5 * i + 3 * j) % 7 - 3))))) AS t FROM q)
SELECT slide_name, x, y, list_concat(list_transform(range(0, 8), lambda j: list_max(list_transform(t, lambda p: p[j + 1]))), list_transform(range(0, 8), lambda j: list_sum(list_transform(t, lambda p: p[j + 1])) / len(t)))::FLOAT[] AS embedding FROM t""")
def token_embeddings(spark, sf_dir):
    """Tokens of a model whose weights are a file, reduced to the class token and the mean of the patches; whole numbers go in."""
    weights = ((5 * np.arange(8)[:, None] + 3 * np.arange(8)) % 7 - 3).astype(np.float32)
    uri = encoder.write_weights(weights, f"{fresh_folder(spark, 'weights')}/{uuid.uuid4().hex}.npy")
    rows = embedding_rows(spark, sf_dir)
    first = rows.select(F.size("embedding")).head()
    tokens = encoder.token_encoder(spark, uri, first[0] if first else 8)
    return encoder.token_embeddings(rows.withColumn("pixels", F.transform("embedding", lambda v: F.floor(v * 16).cast("float"))), tokens, 8)


@query("SELECT path, type, risk_index FROM mapping")
def mapping_csv(spark, sf_dir):
    """Written as a CSV with another name of the third column, and read with declared types."""
    folder = fresh_folder(spark, "mapping")
    fx.mapping(spark, sf_dir).select("path", "type", F.col("risk_index").alias("index")).write.option("header", True).csv(folder)
    return readers.read_mapping(spark, folder, "index")


@query("SELECT p.path, count(t.tile_x)::BIGINT AS n_tiles, (SELECT count(*) FROM slides)::BIGINT AS n_slides FROM slides p LEFT JOIN (SELECT id, tile_x FROM tiles) t ON p.id = t.id GROUP BY p.path")
def dataset_pair(spark, sf_dir):
    """A pair written and read back, with the count that the writer observed."""
    folder = fresh_folder(spark, "pair")
    seen = sinks.write_dataset(fx.slides(spark, sf_dir), _tiles(spark, sf_dir).select("slide_id", "tile_x", "tile_y"), folder, "pair", rows_per_file=256 * 400)
    s, t = readers.read_pair(spark, f"{folder}/pair")
    return dataset.link_tiles(s, t, "left").groupBy("path").agg(F.count("x").alias("n_tiles")).withColumn("n_slides", F.lit(seen["slides"]).cast("bigint"))


@query("""SELECT id AS slide_id, (o % nx * 32)::INTEGER AS tile_x, (o // nx * 32)::INTEGER AS tile_y, ((ahead + o) // 256)::BIGINT AS block
FROM (SELECT id, nx, ny, coalesce(sum(nx * ny) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM counts), unnest(range(0, nx * ny)) AS t(o)""")
def tile_blocks(spark, sf_dir):
    """Tiles in blocks of 256 rows, whatever the size of their slides."""
    return blocks.tile_blocks(fx.slides(spark, sf_dir)).select(F.col("id").alias("slide_id"), "tile_x", "tile_y", "block")


@query("SELECT id AS slide_id, path, tile_x AS x, tile_y AS y FROM tiles")
def bucketed_pair(spark, sf_dir):
    """A pair written in buckets of the slide id, and linked without moving a row."""
    folder = fresh_folder(spark, "buckets")
    s, t = sinks.write_buckets(fx.slides(spark, sf_dir), _tiles(spark, sf_dir).select("slide_id", "tile_x", "tile_y"), folder, f"pair_{folder[-32:]}", 16)
    return dataset.link_tiles(s, t).select("slide_id", "path", "x", "y")


@query("SELECT (vec_id % 7)::VARCHAR AS slide_name, (vec_id * 32)::INTEGER AS x, (label * 32)::INTEGER AS y, embedding FROM embeddings")
def embedding_files(spark, sf_dir):
    """Embeddings written by slide and read back."""
    folder = fresh_folder(spark, "embeddings")
    sinks.write_embeddings(embedding_rows(spark, sf_dir), folder)
    return spark.read.schema(schemas.EMBEDDINGS).parquet(folder)


@query("""SELECT '/m/tissue/' || replace(path[4:], '.mrxs', '.tiff') AS mask_path, y::INTEGER AS y, 4.0::DOUBLE AS mpp_x, (extent_x // 8 + 17)::BIGINT AS n, list_sum(list_transform(range(0, extent_x // 8 + 17), lambda px: CASE WHEN (px * 31 + y * 17 + k * 7) % 11 < k % 11 THEN 1 ELSE 0 END))::BIGINT AS zeros
FROM base, unnest(range(0, extent_y // 8 + 17)) AS t(y)""")
def mask_files(spark, sf_dir):
    """Mask lines written and read back."""
    folder = fresh_folder(spark, "masks")
    sinks.write_masks(fx.masks(spark, sf_dir, ("tissue",)), folder)
    found = spark.read.schema(schemas.MASK_ROWS).parquet(folder)
    return found.select("mask_path", "y", "mpp_x", F.size("row").cast("bigint").alias("n"), F.size(F.filter("row", lambda v: v == 0)).cast("bigint").alias("zeros"))


@query("""WITH """ + fx.SQL + """, held AS (SELECT k, replace(path[4:], '.mrxs', '.tiff') AS name, extent_x // 8 + 17 AS w, extent_y // 8 + 17 AS h FROM base),
full_size AS (SELECT name, w, h, x, y, CASE WHEN (x * 31 + y * 17 + k * 7) % 11 < k % 11 THEN 0 ELSE 255 END AS v FROM held, unnest(range(0, w)) AS a(x), unnest(range(0, h)) AS b(y)),
levels AS (SELECT name, 0 AS level, w, h, x, y, v FROM full_size UNION ALL SELECT name, l, w, h, x // (1 << l), y // (1 << l), max(v) FROM full_size, unnest(range(1, 9)) AS t(l) WHERE 32 * (1 << (l - 1)) < greatest(w, h) GROUP BY ALL)
SELECT name, level::INTEGER AS level, (4.0 * 2 ** level)::DOUBLE AS mpp_x, y::INTEGER AS y, count(*)::BIGINT AS n, sum((x + 1) * (v = 0)::INTEGER)::BIGINT AS zeros FROM levels GROUP BY ALL""")
def mask_pyramids(spark, sf_dir):
    """Masks as tiled files of several levels, read back by ranges of bytes: pixels of each line, and the sum of the places of its zeros."""
    folder = fresh_folder(spark, "pyramids")
    pyramids.write_pyramids(fx.masks(spark, sf_dir, ("tissue",)), folder, side=32)
    levels = stored(spark.read.format("tiles").load(folder), f"{folder}-headers")
    wanted = tiffs.region_tiles(levels.select("path", "level", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("extent_x").alias("width"), F.col("extent_y").alias("height")), levels)
    zeros = F.aggregate(F.transform("row", lambda v, i: F.when(v == 0, F.col("x") + i + 1).otherwise(0).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    lines = tiffs.read_tiles(wanted, levels).groupBy("path", "level", "y").agg(F.sum(F.size("row")).alias("n"), F.sum(zeros).alias("zeros"))
    named = levels.select("path", "level", "mpp_x", F.substring_index("path", "/", -1).alias("name"))
    return lines.join(named.hint("merge"), ["path", "level"]).select("name", "level", "mpp_x", "y", "n", "zeros")


def _mapping_csv(spark, sf_dir):
    """A folder of CSV files with the mapping, as jobs read it."""
    folder = fresh_folder(spark, "mapping")
    fx.mapping(spark, sf_dir).select("path", "type", "risk_index").write.option("header", True).csv(folder)
    return folder


@query("""SELECT path, m.type, tile_x AS x, tile_y AS y, tissue_overlap, blur_overlap, folding_overlap, residual_overlap, epithelium_overlap
FROM tiles JOIN scores USING (k, tile_x, tile_y) JOIN (SELECT path || '.mrxs' AS path, type FROM mapping) m USING (path) WHERE tissue_overlap > 0""")
def tiling_job(spark, sf_dir):
    """The whole job: a mapping file, three levels of which the middle one is nearest, masks, and a pair that is written and read back."""
    levels = fx.base_slides(spark, sf_dir).select("path", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(2.0**i).alias("f")) for i in range(3)])).alias("l"), "extent_x", "extent_y")
    levels = levels.select("path", "l.level", *[(F.col("l.f") / 4).alias(f"mpp_{a}") for a in "xy"], *[(F.col(f"extent_{a}") * 2 / F.col("l.f")).cast("int").alias(f"extent_{a}") for a in "xy"])
    folder = fresh_folder(spark, "job")
    jobs.tiling_job(spark, _mapping_csv(spark, sf_dir), levels, fx.masks(spark, sf_dir), folder, "pair", 0.485, fx.TILE, fx.STRIDE, fx.ROOTS)
    s, t = readers.read_pair(spark, f"{folder}/pair")
    return dataset.link_tiles(s, t).select("path", "type", "x", "y", *[c for c in schemas.TILE_COLUMNS if c.endswith("_overlap")])


@query("""SELECT replace(path[4:], '.mrxs', '') AS slide_name, tile_x AS x, tile_y AS y, list_transform(range(0, 16), lambda j: -(tile_x // 32 * (13 * j % 11 - 5) + tile_y // 32 * ((7 + 13 * j) % 11 - 5) + ((14 + 13 * j) % 11 - 5)))::FLOAT[] AS embedding FROM tiles""")
def embeddings_job(spark, sf_dir):
    """Two jobs with one output, encoder and transform by name: the second embeds the slides that the first wasn't given, and its manifest tells which."""
    out, s = fresh_folder(spark, "embedded"), fx.slides(spark, sf_dir)
    tiles = _tiles(spark, sf_dir).select("slide_id", "tile_x", "tile_y")
    load = lambda df: df.withColumn("pixels", F.array(*[(v / 32).cast("float") for v in (F.col("x"), F.col("y"))], F.lit(1.0).cast("float")))
    for given in (s.where("k % 3 = 0"), s):
        jobs.embeddings_job(spark, [], out, load, "tilewright.operators.embeddings.small_projection", transform="numpy.negative", pairs=[(given, tiles)])
    return jobs.read_embeddings(spark, out)


@query("""SELECT path AS wsi_path, (CASE WHEN k % 500 = 7 THEN -1 WHEN k % 4 = 1 THEN 500 WHEN k % 4 = 3 THEN 404 ELSE 200 END)::INTEGER AS status, (CASE WHEN k % 500 <> 7 AND k % 4 = 1 THEN 2 ELSE 1 END)::INTEGER AS attempts,
CASE WHEN k % 500 = 7 THEN 'timeout' WHEN k % 4 = 1 THEN 'exhausted' ELSE 'done' END AS outcome, CASE WHEN k % 500 = 7 THEN 'Timeout' WHEN k % 4 = 1 THEN 'Internal Server Error' END AS error FROM base
UNION ALL SELECT 'http://qc/report', 200, 1, 'done', NULL FROM (SELECT count(*) AS n FROM base), unnest(range(0, ceil(n / 10000)::BIGINT))""")
def quality_control_job(spark, sf_dir):
    """A request per slide, of which some hang and run into the time limit, and then the report on all of them in as few requests as bound their size."""
    import json
    import time

    def call(item):
        sent = json.loads(item["payload"])
        k = int(sent["wsi_path"].split(".")[-2])
        if k % 500 == 7:
            time.sleep(30)
        return (500, "Internal Server Error") if k % 4 == 1 else (404, "missing") if k % 4 == 3 else (200, "ok")

    def report(item):
        sent = json.loads(item["payload"])
        return (200 if sent["backgrounds"] and sent["mask_dir"] == "/masks" else 404), "ok"

    done, sent = jobs.quality_control_job(spark, _mapping_csv(spark, sf_dir), call, "/masks", 3, 1, most=2, url="http://qc/", report=report, save_location="/reports", sleep=lambda seconds: None, timeout=2.0)
    return done.unionByName(sent)


def _graymaps(spark, sf_dir):
    """(path, content): two lines of pixels per slide, with its resolution in a comment."""
    s = fx.base_slides(spark, sf_dir).select("path", "k", (F.col("extent_x") / 32 % 9 + 1).cast("int").alias("w"), ((F.col("k") % 3 + 1) / 4).alias("mpp"))
    head = F.format_string("P5\n# slide=%s mpp_x=%.2f mpp_y=%.2f\n%d 2\n255\n", "path", "mpp", "mpp", "w")
    pixel = lambda i: F.lpad(F.hex((i % F.col("w") + F.floor(i / F.col("w")) + F.col("k")) % 250), 2, "0")
    body = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), 2 * F.col("w") - 1), pixel), ""))
    return s.select("path", F.concat(head.cast("binary"), body).alias("content"))


@query("SELECT path, 0 AS level, (k % 3 + 1) / 4 AS mpp_x, (k % 3 + 1) / 4 AS mpp_y, (extent_x // 32 % 9 + 1)::INTEGER AS extent_x, 2 AS extent_y FROM base")
def slide_headers(spark, sf_dir):
    return readers.levels_of(_graymaps(spark, sf_dir))


def _slide_files(spark, sf_dir):
    """The graymaps as files, and the data source that reads their headers."""
    graymaps.register(spark)
    folder = fresh_folder(spark, "slides")
    named = _graymaps(spark, sf_dir).select(F.concat(F.md5("path"), F.lit(".pgm")).alias("name"), "content")
    named.write.format("graymap").mode("append").save(folder)
    return spark.read.format("graymap").load(folder)


@query("SELECT path, 0 AS level, (k % 3 + 1) / 4 AS mpp_x, (k % 3 + 1) / 4 AS mpp_y, (extent_x // 32 % 9 + 1)::INTEGER AS extent_x, 2 AS extent_y FROM base")
def slide_files(spark, sf_dir):
    """Headers of graymap files through the data source, which reads some kilobytes of each."""
    return _slide_files(spark, sf_dir).select("path", "level", "mpp_x", "mpp_y", "extent_x", "extent_y")


@query("""SELECT path, x::INTEGER AS x, list_transform(range(0, 9), lambda i: CASE WHEN x + i % 3 < extent_x // 32 % 9 + 1 AND i // 3 < 2 THEN (x + i % 3 + i // 3 + k) % 250 ELSE 0 END)::SMALLINT[] AS pixels
FROM base, unnest(range(0, 9, 2)) AS t(x) WHERE x <= extent_x // 32 % 9""")
def tile_pixels_of_files(spark, sf_dir):
    """Tiles of 3 by 3 pixels at half overlap, from byte ranges of the files."""
    headers = stored(_slide_files(spark, sf_dir), fresh_folder(spark, "headers"))
    tiles = headers.select("path", "level", F.explode(F.sequence(F.lit(0), F.col("extent_x") - 1, F.lit(2))).alias("x"), F.lit(0).alias("y"))
    return pixels.tile_pixels(tiles, graymaps.read_lines(tiles, headers, 3), 3).select("path", "x", "pixels")


@query("SELECT replace(path[4:], '.mrxs', '.tiff') AS mask_path, y::INTEGER AS y, (k % 3 + 1) / 4 AS mpp_x, list_transform(range(0, extent_x // 32 % 9 + 1), lambda x: (CASE WHEN (x + y + k) % 250 < 100 * (k % 3 + 1) / 4 THEN 255 ELSE 0 END)::SMALLINT) AS row FROM base, unnest(range(0, 2)) AS t(y)")
def tissue_masks(spark, sf_dir):
    """Masks at each slide's own resolution, which the stand-in's limit follows, written and read back."""
    files, folder = _graymaps(spark, sf_dir), fresh_folder(spark, "tissue")
    jobs.tissue_masks_job(files, readers.levels_of(files), 0, lambda data, mpp: pixels.dark_tissue(100 * mpp)(data), folder)
    return spark.read.schema(schemas.MASK_ROWS).parquet(folder).select("mask_path", "y", "mpp_x", "row")


@query()
def tissue_segmentation(spark, sf_dir):
    """Tissue pixels per line of the stand-in rasters, by each slide's own threshold; tested against loops over pixels."""
    lines = fx.masks(spark, sf_dir, ("tissue",)).select(F.col("mask_path").alias("path"), "y", "row")
    levels = lines.select("path").distinct().withColumn("mpp", F.lit(4.0))
    found = segmentation.tissue_lines(lines, levels, radius=4.0, area=500.0, band=32)
    return found.select("path", "y", F.size(F.filter("row", lambda v: v == 255)).alias("n_tissue"))


@query("SELECT '/d/' || p_brand || '.' || k || '.mrxs' AS wsi_path, '/m/tissue/' || p_brand || '.' || k || '.tiff' AS tissue_mask_path, '/m/epithelium/' || p_brand || '.' || k || '.tiff' AS output_path, 'segmentation-1' AS model FROM p")
def heatmap_requests(spark, sf_dir):
    return jobs.heatmap_items(fx.mapping(spark, sf_dir), "/m/tissue", "/m/epithelium", "segmentation-1")


@query("""SELECT 'http://qc/report' AS url, '{"backgrounds":[' || string_agg('"' || path || '"', ',' ORDER BY path) || '],"mask_dir":"/masks","save_location":"/reports","compute_metrics":true}' AS payload FROM base GROUP BY k % 16""")
def report_bodies(spark, sf_dir):
    """The report in sixteen requests of bounded size."""
    wanted = fx.base_slides(spark, sf_dir).select(F.col("path").alias("wsi_path"), "k")
    return tasks.report_requests(wanted, "http://qc/", "/masks", "/reports", part=F.col("k") % 16)


@query("SELECT path, (k % 2 = 0)::INTEGER AS target FROM mapping")
def label_target(spark, sf_dir):
    return labels.process_slides(fx.mapping(spark, sf_dir), "type").select("path", F.col(labels.target_column("type")).cast("int").alias("target"))
