"""Intermediate tables for algorithms that read the same derived rows many times.

They live in the folder all executors share, ``spark.checkpoint.dir``, under one
folder per application that is removed when the application ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}      # application id -> folder of a local session
_SEEN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names.

    A local session (driver and executors are one process, as in tests) may leave it
    unset and gets a folder of its own. On a cluster that is an error: no other folder
    is known to be seen by all executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[app]


def _remove(spark: SparkSession, folder: str):
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:       # the JVM is gone already: nothing left to ask
        pass


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder, gone when the application ends."""
    folder = os.path.join(shared_folder(spark), "caseloom-" + spark.sparkContext.applicationId)
    if folder not in _SEEN:
        _SEEN.add(folder)
        atexit.register(_remove, spark, folder)
    return os.path.join(folder, uuid.uuid4().hex)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: later passes scan the table, and a lost
    executor costs a re-read, not a recomputation."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Kept:
    """A table that is written again and again: each version replaces the last one."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, None
        self.write(df)

    def write(self, df: DataFrame):
        old, path = self.path, scratch(self.spark)
        df.write.parquet(path)
        self.df, self.path = self.spark.read.schema(df.schema).parquet(path), path
        if old:
            _remove(self.spark, old)

    def drop(self):
        _remove(self.spark, self.path)


def size_bound(df: DataFrame) -> float:
    """The optimizer's estimate of the table's size in bytes, infinite if unknown."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no statistics on this kind of session
        return float("inf")


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a size the planner knows.

    A table that may be large for all the optimizer can tell (the groups of a big
    log, say) is written once and read back. The join that uses it is then planned
    from its true size: broadcast if small, shuffled if not.
    """
    if limit is None:
        limit = 10 << 20
    return df if size_bound(df) <= limit else staged(df)
