"""Intermediate tables: written to a folder that the driver and all executors share, so that a lost executor costs no recomputed calls."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one the context was given. Without either, a temporary one in local mode alone: elsewhere executors couldn't see it."""
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if not given.isEmpty():
        return spark.conf.get("spark.checkpoint.dir", None) or given.get()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tilewright-")
    context.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows that one task reads of a packed table.
PACKED_ROWS = 1 << 13


def packed(df: DataFrame, task_rows: int = PACKED_ROWS) -> DataFrame:
    """A checkpoint that is read by tasks of some `task_rows` rows, in as few partitions as that takes (one per core at least, and never more than there were).

    A small table that a shuffle left in many partitions would cost a task for each of them whenever it is read, and the driver keeps something of every task.
    """
    seen = Observation()
    held = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return held.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-seen.get["n"] // task_rows)))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The same rows, written once to `folder` and read from there. Unlike a checkpoint, nothing is computed twice, and the folder can be dropped."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this module's making, which nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
