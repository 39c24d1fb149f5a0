"""Where driver loops cut their lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="trellis-grid-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local runs that leave it unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local_dir()
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again. For loops: the plan stays small and no lost executor undoes the loop."""
    spark = df.sparkSession
    path = f"{_scratch(spark.sparkContext.applicationId, shared_dir(spark))}/grid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Removes a loop's settled state once the next one, which doesn't read it, is written. Returns the new one."""
    if old is not None:
        _remove(old.sparkSession, old._settled_at)
    return new


@functools.cache
def _scratch(application: str, shared: str) -> str:
    """This application's part of the shared folder; it goes when the driver's Python ends."""
    path = f"{shared}/trellis-grid-{application}"
    atexit.register(lambda: _remove(SparkSession.getActiveSession(), path))
    return path


def _remove(spark: SparkSession | None, path: str) -> None:
    if spark is None:
        return
    with contextlib.suppress(Exception):  # what can't be removed does no harm
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
