"""Outputs that grow run by run, with a small table of the keys that are finished.

    <root>/run=<id>/         a run's rows, in files of a bounded number of rows
    <root>/_keys/<id>/       its keys, and how many rows each has
    <root>/_commits/<id>     an empty file, made when both are whole: it commits rows and keys together

What has no commit (a lost job, a torn write) is met by no reader. Keys that two jobs wrote at the same time count by the run that began first. All files are
reached through Spark's own file systems; nothing relies on renaming, so stores without it will do.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one file.
ROWS_PER_FILE = 1 << 17


def _store(spark: SparkSession, path: str):
    """A path of the JVM and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, store = _store(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []


def committed(spark: SparkSession, root: str) -> list[str]:
    """The runs whose rows and keys are whole, in the order in which they began."""
    return [n for n in _names(spark, f"{root}/_commits") if not n.startswith((".", "_"))]


def append(rows: DataFrame, root: str, key: str, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Adds a run of `rows`, as they are partitioned, and returns its id. The keys are read off the rows that were written, so both agree."""
    spark, run = rows.sparkSession, f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{root}/run={run}")
    written = spark.read.schema(rows.schema).parquet(f"{root}/run={run}")
    written.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/_keys/{run}")
    path, store = _store(spark, f"{root}/_commits/{run}")
    store.create(path, False).close()
    return run


def keys(spark: SparkSession, root: str) -> DataFrame:
    """key, run and n of what is finished: a key once, with its first run. Reads the tables of keys alone."""
    runs = committed(spark, root)
    if not runs:
        return spark.createDataFrame([], "key string, run string, n bigint")
    listed = spark.read.parquet(*[f"{root}/_keys/{r}" for r in runs]).withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return listed.groupBy("key").agg(F.min_by(F.struct("run", "n"), "run").alias("first")).select("key", "first.*")


def read(spark: SparkSession, root: str, key: str, schema: str) -> DataFrame:
    """The rows of all committed runs. Only where runs share keys are rows joined to the keys' first runs."""
    runs = committed(spark, root)
    if not runs:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/run={r}" for r in runs])
    names = [n for n in rows.columns if n != "run"]
    listed = spark.read.parquet(*[f"{root}/_keys/{r}" for r in runs])
    if len(runs) > 1 and not listed.groupBy("key").count().where("count > 1").isEmpty():
        first = keys(spark, root).select(F.col("key").alias("_key"), F.col("run").alias("_run"))
        rows = rows.join(first.hint("shuffle_hash"), rows[key].eqNullSafe(F.col("_key")) & (F.col("run") == F.col("_run")), "left_semi")
    return rows.select(*names)


def clear_torn(spark: SparkSession, root: str, older_than: float) -> list[str]:
    """Deletes runs that were never committed and began over `older_than` seconds ago, which must be longer than a job takes; returns their ids."""
    whole = set(committed(spark, root))
    begun = {n.removeprefix("run=") for n in _names(spark, root) if n.startswith("run=")}
    torn = sorted(r for r in begun - whole if int(r.split("-")[0]) < time.time_ns() - older_than * 1e9)
    for run in torn:
        for folder in (f"{root}/run={run}", f"{root}/_keys/{run}"):
            path, store = _store(spark, folder)
            store.delete(path, True)
    return torn
