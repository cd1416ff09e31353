"""Stand-ins over the driver's tables: slides, masks and metadata from `part`, an attempt log from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import slides as slide_ops
from tilewright.operators.tiling import MaskRoots

TILE, STRIDE, SCALE = 64, 32, 8
#: How often the eleven pixels of a line's pattern repeat in a line of usual width.
USUAL = 24
ROOTS = MaskRoots("/m/tissue", "/m/epithelium", "/m/qc")
#: Mask kind -> (folder and file prefix, salt of its pixels).
KINDS = {
    "tissue": ("/m/tissue/", 0),
    "epithelium": ("/m/epithelium/", 1),
    "blur": ("/m/qc/Piqe_piqe_median_activity_mask_", 3),
    "folding": ("/m/qc/FoldingFunction_folding_test_", 5),
    "residual": ("/m/qc/ResidualArtifactsAndCoverage_coverage_mask_", 7),
}


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is one small file, from which much is generated: it is dealt to all cores first."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 2 == 0, "a luminal").otherwise("b luminal")
    return part(spark, sf_dir).select(F.concat(F.lit("/d/"), "p_brand", F.lit("."), F.col("p_partkey").cast("string")).alias("path"), kind.alias("type"), (F.col("p_partkey") % 97 / 4).alias("risk_index"), F.col("p_partkey").alias("k"))


def base_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides without metadata: path, k, extents, tile and stride, resolution, level."""
    p = part(spark, sf_dir)
    path = F.concat(F.lit("/d/"), "p_brand", F.lit("."), F.col("p_partkey").cast("string"), F.lit(".mrxs"))
    sizes = {f"{n}_{a}": F.lit(v) for n, v in (("tile_extent", TILE), ("stride", STRIDE)) for a in "xy"}
    return p.select(path.alias("path"), F.col("p_partkey").alias("k"), (F.col("p_size") * 32).cast("int").alias("extent_x"), ((F.col("p_size") % 7 + 1) * 40).cast("int").alias("extent_y"), *[v.alias(k) for k, v in sizes.items()], F.lit(0.5).alias("mpp_x"), F.lit(0.5).alias("mpp_y"), F.lit(0).alias("level"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With metadata (none for every third slide) and id; dealt to all cores again, as the join leaves few partitions of a table from which much is generated."""
    meta = slide_ops.slide_metadata(mapping(spark, sf_dir).where("k % 3 <> 0"))
    return slide_ops.add_id(slide_ops.join_metadata(base_slides(spark, sf_dir), meta)).repartition(2 * spark.sparkContext.defaultParallelism, "id")


def masks(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Raster lines of the five kinds (or those named), at an eighth of the slide's resolution and wide enough for tiles that hang over."""
    s = base_slides(spark, sf_dir).select("k", F.concat(F.regexp_extract("path", "([^/]*)\\.mrxs$", 1), F.lit(".tiff")).alias("file"), "extent_x", "extent_y")
    kinds = F.array(*[F.struct(F.lit(prefix).alias("prefix"), F.lit(salt).alias("salt")) for prefix, salt in (KINDS[n] for n in names)])
    lines = s.select("*", F.explode(kinds).alias("kind")).select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("extent_y") / SCALE).cast("int") + 2 * SCALE)).alias("y"))
    # A line's pixels follow from two remainders: each of the 121 kinds of line is one row of a literal table, of the widest line's length.
    patterns = [F.array(*[F.lit(0 if (px * 31 + r) % 11 < m else 255).cast("smallint") for px in range(11)]) for r in range(11) for m in range(11)]
    line = lambda p: F.get(F.array(*p), ((F.col("y") * 17 + F.col("k") * 7 + F.col("kind.salt")) % 11 * 11 + F.col("k") % 11).cast("int"))
    repeated = lambda p, n: F.flatten(F.array_repeat(p, n))
    width = F.floor(F.col("extent_x") / SCALE).cast("int") + 2 * SCALE + 1
    # Lines of usual width are cut from literals that are made once; only wider ones are put together row by row.
    usual = F.slice(line([repeated(p, F.lit(USUAL)) for p in patterns]), F.lit(1), width)
    row = F.when(width <= 11 * USUAL, usual).otherwise(F.slice(repeated(line(patterns), F.ceil(width / 11).cast("int")), F.lit(1), width))
    return lines.select(F.concat("kind.prefix", "file").alias("mask_path"), "y", F.lit(0.5 * SCALE).alias("mpp_x"), F.lit(0.5 * SCALE).alias("mpp_y"), row.alias("row"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt log by user: errors are retryable answers, views time out for some users."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    error, late = F.col("event_type") == "error", (F.col("event_type") == "view") & (F.col("user_id") % 5 == 0)
    status = F.when(error, 500).when(late, -1).otherwise(200)
    text = F.when(error, "Internal Server Error").when(late, "Timeout").otherwise("ok")
    return e.select(F.concat(F.lit("/d/"), F.col("user_id").cast("string")).alias("wsi_path"), F.col("event_id").alias("attempt"), status.alias("status"), text.alias("text"))


#: The same in SQL, as common table expressions.
SQL = r"""
p AS (SELECT p_partkey AS k, p_brand, p_size, '/d/' || p_brand || '.' || p_partkey AS bare FROM part),
mapping AS (SELECT bare AS path, CASE WHEN k % 2 = 0 THEN 'a luminal' ELSE 'b luminal' END AS type, k % 97 / 4 AS risk_index, k FROM p),
base AS (SELECT bare || '.mrxs' AS path, k, (p_size * 32)::INTEGER AS extent_x, ((p_size % 7 + 1) * 40)::INTEGER AS extent_y FROM p),
meta AS (SELECT path || '.mrxs' AS slide_path, type, risk_index FROM mapping WHERE k % 3 <> 0),
slides AS (SELECT base.*, type, risk_index, sha256(path || '|0|' || extent_x || '|' || extent_y || '|64|64|32|32|' || coalesce(type, '')) AS id FROM base LEFT JOIN meta ON path = slide_path),
counts AS (SELECT *, greatest(1, ceil((extent_x - 64) / 32)::INTEGER + 1) AS nx, greatest(1, ceil((extent_y - 64) / 32)::INTEGER + 1) AS ny FROM slides),
tiles AS (SELECT (ix * 32)::INTEGER AS tile_x, (iy * 32)::INTEGER AS tile_y, c.* FROM counts c, unnest(range(0, nx)) AS a(ix), unnest(range(0, ny)) AS b(iy)),
px AS (SELECT DISTINCT k, tile_x, tile_y FROM tiles),
areas AS (SELECT r, z, lo, avg(CASE WHEN (dx * 31 + dy * 17 + r) % 11 < z THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS zero
  FROM range(0, 11) AS a(r), range(0, 11) AS b(z), (VALUES (2, 6), (0, 8)) AS e(lo, hi), unnest(range(lo, hi)) AS u(dx), unnest(range(lo, hi)) AS v(dy) GROUP BY ALL),
shares AS (SELECT k, tile_x, tile_y, m.name, zero
  FROM px, (VALUES ('tissue', 0, 2), ('epithelium', 1, 0), ('blur', 3, 0), ('folding', 5, 0), ('residual', 7, 0)) AS m(name, salt, lo)
  JOIN areas ON areas.lo = m.lo AND areas.z = k % 11 AND areas.r = (tile_x // 8 * 31 + tile_y // 8 * 17 + k * 7 + m.salt) % 11),
scores AS (SELECT k, tile_x, tile_y,
  max(CASE WHEN name = 'tissue' THEN CASE WHEN zero = 0 THEN 0.0::DOUBLE ELSE 1 - zero END END) AS tissue_overlap,
  max(CASE WHEN name = 'blur' THEN CASE WHEN zero = 1 THEN 0.0::DOUBLE ELSE zero END END) AS blur_overlap,
  max(CASE WHEN name = 'folding' THEN CASE WHEN zero = 1 THEN 0.0::DOUBLE ELSE zero END END) AS folding_overlap,
  max(CASE WHEN name = 'residual' THEN CASE WHEN zero = 0 THEN 0.0::DOUBLE ELSE 1 - zero END END) AS residual_overlap,
  max(CASE WHEN name = 'epithelium' THEN CASE WHEN zero = 0 THEN 0.0::DOUBLE ELSE 1 - zero END END) AS epithelium_overlap
  FROM shares GROUP BY k, tile_x, tile_y)
"""
