"""The five jobs as functions of a session and their parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import paths
from tilewright.operators import dataset, embeddings, slides, tasks, tiling
from tilewright.sources import manifest, readers, schemas, sinks

#: Resolution (microns per pixel) of the four tilings by level, all of 224-pixel tiles at half overlap.
EXPERIMENTS = {level: {"mpp": mpp, "tile_extent": 224, "stride": 112} for level, mpp in enumerate((0.24, 0.485, 0.97, 1.94))}
#: Mask pixels that are handed on at a time.
CELLS = 1 << 20


def tiling_job(spark: SparkSession, mapping_csv: str, levels: DataFrame, masks: DataFrame, out: str, name: str, mpp: float, tile_extent: int, stride: int, roots: tiling.MaskRoots, mode: str = "reference", rows_per_file: int = 0) -> dict[str, int]:
    """Slides and tiles of a mapping, written as a pair; returns their counts.

    The id is a hash of the slide's own columns, so both outputs agree on it without keeping the slides in memory.
    """
    mapping = readers.read_mapping(spark, mapping_csv)
    listed = slides.slide_metadata(mapping)
    wanted = listed.select(F.col("slide_path").alias("path"))
    found = slides.read_slides(levels, mpp, tile_extent, stride).join(wanted.hint("merge"), "path")
    # Tiles are generated from few bytes: the slides are dealt to all cores first.
    table = slides.add_id(slides.join_metadata(found, listed)).repartition(2 * spark.sparkContext.defaultParallelism, "id")
    return sinks.write_dataset(table, tiling.tile_slides(table, masks, tile_extent, roots, mode), out, name, rows_per_file)


def embeddings_job(
    spark: SparkSession, roots: list[str], out: str, load: Callable[[DataFrame], DataFrame], make_encoder: str | Callable, mode: str = "full", transform: str | Callable | None = None,
    pairs: Sequence[tuple[DataFrame, DataFrame]] = (), task_rows: int = embeddings.TASK_ROWS, rows_per_file: int = manifest.ROWS_PER_FILE, profile: ResourceProfile | None = None,
) -> int:
    """Embeddings of the slides that have none yet; returns the slides done.

    `load` adds `pixels` to (slide_name, slide_id, x, y); tiles come to it in ranges of some `task_rows`. Encoder and transform may be given by dotted name.
    What is finished is told by the manifest of `out`, which is committed with the rows; a slide without tiles has no rows, and stays pending.
    """
    slide_table, tiles = readers.read_pair(spark, *roots, pairs=pairs)
    todo = embeddings.pending(slide_table, written_keys(spark, out, mode), mode)
    count = todo.count()
    if count:
        samples = embeddings.dealt(dataset.samples_of(todo, tiles), task_rows)
        found = embeddings.encode(load(samples), make_encoder, transform=transform, profile=profile)
        manifest.append(found, out, "slide_name", rows_per_file)
    return count


def written_keys(spark: SparkSession, out: str, mode: str = "full") -> DataFrame:
    """Keys of the embeddings that are finished below `out`, by its manifest; none where nothing was written yet."""
    return manifest.keys(spark, out).select(paths.stem(F.col("key")).alias("key") if mode == "reference" else "key").distinct()


def read_embeddings(spark: SparkSession, out: str) -> DataFrame:
    """slide_name, x, y, embedding of all finished slides below `out`."""
    return manifest.read(spark, out, "slide_name", schemas.EMBEDDINGS)


def quality_control_job(
    spark: SparkSession, mapping_csv: str, call: Callable[[dict], tuple[int, str]], output_path: str, mask_level: int, sample_level: int, limit: int = 4, most: int = tasks.MOST,
    url: str | None = None, report: Callable[[dict], tuple[int, str]] | None = None, save_location: str = "", metrics: bool = True, part: Column | None = None, **how,
) -> tuple[DataFrame, DataFrame | None]:
    """The outcomes of one request per slide, and of the report that follows when all of them have ended.

    `call` gets wsi_path and payload, `report` gets url and payload; a slide whose request failed is in the report too. `how` has sleep and timeout.
    """
    path = F.col("wsi_path")
    items = readers.read_mapping(spark, mapping_csv).select(paths.slide_path(F.col("path")).alias("wsi_path"))
    done = tasks.call_all(items.withColumn("payload", tasks.qc_payload(path, output_path, mask_level, sample_level)), call, limit, most, **how)
    if report is None:
        return done, None
    requests = tasks.report_requests(items, url or "", output_path, save_location, part, metrics)
    return done, tasks.call_all(requests.withColumn("wsi_path", F.col("url")), report, limit, 1, **{"timeout": tasks.REPORT_SECONDS} | how)


def tissue_masks_job(files: DataFrame, levels: DataFrame, level: int, segment: Callable[[bytes, float], list[list[int]]], out: str, profile: ResourceProfile | None = None) -> None:
    """Mask rows of (path, content), the pixels of each slide at `level`, by a `segment` function that returns lines of 0 and 255.

    Each slide has the resolution that `levels` gives for it; `segment` gets the mean of both axes, and is called once per slide. Lines leave it mask by mask and in
    order, so they are written as they come; they are handed on by some CELLS pixels, whether a slide has more or fewer.
    """
    known = levels.where(F.col("level") == level).select("path", "mpp_x", "mpp_y")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, cells = [], 0
            for path, content, x, y in zip(frame["path"], frame["content"], frame["mpp_x"], frame["mpp_y"], strict=True):
                lines = segment(content, (x + y) / 2)
                held.extend((path, k, x, y, line) for k, line in enumerate(lines))
                cells += sum(map(len, lines)) + len(lines)
                if cells >= CELLS:
                    yield pd.DataFrame(held, columns=["path", "y", "mpp_x", "mpp_y", "row"])
                    held, cells = [], 0
            if held:
                yield pd.DataFrame(held, columns=["path", "y", "mpp_x", "mpp_y", "row"])

    rows = files.select("path", "content").join(known.hint("shuffle_hash"), "path").mapInPandas(run, "path string, y int, mpp_x double, mpp_y double, row array<smallint>", profile=profile)
    rows.select(paths.with_suffix_name(F.col("path")).alias("mask_path"), "y", "mpp_x", "mpp_y", "row").write.mode("overwrite").parquet(out)


def heatmap_items(mapping: DataFrame, tissue_root: str | None, out: str, model: str) -> DataFrame:
    """wsi_path, tissue_mask_path, output_path and model of the heat-map requests."""
    path = paths.slide_path(F.col("path"))
    return mapping.select(path.alias("wsi_path"), paths.mask_path(path, tissue_root).alias("tissue_mask_path"), paths.mask_path(path, out).alias("output_path"), F.lit(model).alias("model"))


def epithelium_masks_job(spark: SparkSession, mapping_csv: str, tissue_root: str, out: str, model: str, call: Callable[[dict], tuple[int, str]], limit: int = 4, timeout: float | None = tasks.HEATMAP_SECONDS) -> DataFrame:
    """One heat-map request per slide, with its tissue mask, output path and model; failures are outcomes, not errors."""
    return tasks.call_all(heatmap_items(readers.read_mapping(spark, mapping_csv), tissue_root, out, model), call, limit, most=1, timeout=timeout)
