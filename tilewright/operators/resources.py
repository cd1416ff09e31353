"""Resources of single stages: what encoders and segmentations ask for, while the stages around them keep the defaults."""

from __future__ import annotations

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession

#: Fixed value: memory that a segmentation of one slide reserves.
SEGMENTATION_MEMORY = "3g"


def stage_profile(spark: SparkSession, task_cpus: int = 1, executor_cores: int | None = None, python_memory: str | None = None, gpus: int = 0, gpu_script: str = "") -> ResourceProfile | None:
    """A profile for `mapInPandas` and `mapInArrow`: cores of a task and of its executors, memory of the Python workers, and `gpus` of each executor, one for each task.

    None in local mode, whose one executor can't be changed; stages then run with what there is. On a cluster other executors are only started where dynamic
    allocation is on, so memory and GPUs need it.
    """
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return None
    return profile_of(task_cpus, executor_cores, python_memory, gpus, gpu_script)


def profile_of(task_cpus: int = 1, executor_cores: int | None = None, python_memory: str | None = None, gpus: int = 0, gpu_script: str = "") -> ResourceProfile:
    executor, task = ExecutorResourceRequests(), TaskResourceRequests().cpus(task_cpus)
    if executor_cores:
        executor.cores(executor_cores)
    if python_memory:
        executor.pysparkMemory(python_memory)
    if gpus:
        executor.resource("gpu", gpus, gpu_script)
        task.resource("gpu", 1)
    return ResourceProfileBuilder().require(executor).require(task).build
