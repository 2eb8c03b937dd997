"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Result = TypeVar("Result")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and driver and executors are one process (``local[n]``) a temporary folder
    does; on a cluster its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tabscope-")
        spark.sparkContext.setCheckpointDir(configured)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def materialised(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixed partitions and order, and a lineage that survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of one task of an iterative fit, and the least number of tasks.
ROWS_PER_TASK = 50_000
LEAST_TASKS = 12


def spread(df: DataFrame, n_rows: int) -> DataFrame:
    """Deal ``n_rows`` rows evenly, however few files they come in, over as many partitions as they fill.

    ``spark.sql.shuffle.partitions`` is the most. A fit runs hundreds of jobs over them: with few rows in a task, starting it is
    all the time that passes. The number does not depend on the machine, so neither do the results.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(most, max(LEAST_TASKS, -(-n_rows // ROWS_PER_TASK))))


def dealt(df: DataFrame) -> tuple[int, bool]:
    """The number of rows, and whether no partition holds more than twice its part of the least tasks: then nothing need be dealt anew."""
    # One number per partition.
    held = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    return sum(held), bool(held) and max(held) * LEAST_TASKS <= 2 * sum(held)


def together(spark: SparkSession, steps: Sequence[Callable[[], Result]], at_once: int) -> list[Result]:
    """Results of independent steps in their order, ``at_once`` of them running at a time; the first error is raised."""
    if at_once < 2:
        return [step() for step in steps]
    with ThreadPool(at_once) as pool:
        return pool.map(lambda step: inheritable_thread_target(spark)(step)(), steps, chunksize=1)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run here delete what they have shuffled when they end, not when the driver happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own in the shared folder, once nothing reads it any more."""
    if not path.startswith(f"{shared_folder(spark).rstrip('/')}/"):
        raise ValueError(f"{path} is not in the shared folder")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
