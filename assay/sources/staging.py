"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where that is unset a local session gets one of its own; on a
    cluster it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="assay-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What is written there is deleted when the session's JVM ends: a DataFrame that reads
    it may be run until then."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    if (asked := _asked.get()) is not None:
        asked.append(path)
    return path


#: Spark's own setting by which the shuffle files of an execution go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_asked: ContextVar[list[str] | None] = ContextVar("staged paths", default=None)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths that are given out within, in a list; other threads' are not in it."""
    paths: list[str] = []
    outer = _asked.get()
    token = _asked.set(paths)
    try:
        yield paths
    finally:
        _asked.reset(token)
        if outer is not None:
            outer.extend(paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables whose readers have run, and let Spark's cleaner drop the shuffles that only they held."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


def staged(df: DataFrame, label: str, packed: bool = False) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back, so that a lost executor costs nothing computed before.

    packed: rows hold large packed bodies, which are neither packed again nor gathered in large row groups."""
    path = shared_path(df.sparkSession, label)
    write = df.write.option("compression", "zstd")
    if packed:
        write = df.write.option("compression", "uncompressed").option("parquet.block.size", str(8 << 20)).option("parquet.enable.dictionary", "false")
    conf = df.sparkSession.conf
    had = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")  # what this write shuffled is of no use after it
    try:
        write.parquet(path)
    finally:
        conf.set(CLEANUP, had) if had is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)
