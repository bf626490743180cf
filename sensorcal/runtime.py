"""Where intermediate results that must survive executor loss are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import cache
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

R = TypeVar("R")


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: ``spark.checkpoint.dir``, else the folder set on the context, else the warehouse.

    Only a session whose tasks run inside the driver's machine (a ``local`` master, as in tests) may fall back to
    a folder of this machine. On a cluster a warehouse on the local disk is refused: executors would each write
    to their own disk and readers would miss rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    return fallback_dir(spark.sparkContext.master, spark.conf.get("spark.sql.warehouse.dir", ""))


def fallback_dir(master: str, warehouse: str) -> str:
    """The folder where neither the session nor the context names one."""
    if master.split("[")[0] == "local":
        return _local_dir()
    if warehouse and "://" in warehouse and not warehouse.startswith("file:"):
        return f"{warehouse.rstrip('/')}/_scratch"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="sensorcal-")


def checkpointed(spark: SparkSession) -> None:
    """Lets MLlib cut the lineage of its iterations: without a folder on the context it never does."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/sensorcal/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result is read several times and has to be the same rows each time (a numbering, a
    training set). The written table replaces the lineage, so losing an executor costs a re-read only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def written_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table that ``materialize`` returned."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def release(*tables: DataFrame) -> None:
    """Delete written tables (as ``materialize`` returned them) that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_together(spark: SparkSession, jobs: Sequence[Callable[[], R]], parallelism: int = 4) -> list[R]:
    """Results of independent driver-side jobs (model fits), submitted from a few threads so that the cluster stays busy."""
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs, chunksize=1)
