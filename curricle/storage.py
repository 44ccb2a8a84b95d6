"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
#: What the scope that is open in this thread has written.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where one machine runs everything, and the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="curricle-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def written() -> list[str]:
    """Paths of all scratch tables that are still there."""
    return list(_written)


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """The list of scratch paths that this thread makes within; those that are still there at its end belong to the scope around it."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)
        around = _scope.get()
        if around is not None:
            around += [p for p in paths if p in _written]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for path in list(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _written:
            _written.remove(path)


def forget(spark: SparkSession) -> None:
    """Collects the driver's garbage, so that Spark deletes the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark:
            release(spark, written())
    except Exception:  # the session may be gone at exit; the folder is scratch space
        return


atexit.register(_sweep)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    held = _scope.get()
    if held is not None:
        held.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there and lost executors don't matter."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
