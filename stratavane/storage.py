"""Intermediate tables in the cluster's shared folder.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` (read from the session), so
that a lost executor never takes an intermediate result with it.  Only where the setting is
missing on a local master (tests, a notebook on one machine) is a temporary folder used instead.
Shuffle files go as soon as the table they were made for is written, and tables when their
``scratch`` block ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: str | None = None
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else, on one machine, one of this process."""
    global _fallback
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _fallback is None:
        _fallback = "file://" + tempfile.mkdtemp(prefix="stratavane-")
    return _fallback


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (to ``path``, if given) and return the written table: materialised once,
    without lineage, and safe against lost executors.  The write's own shuffle files are deleted."""
    spark = df.sparkSession
    path, before = path or new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a staged table that nothing will read again; other frames are left alone."""
    path = getattr(df, "_staged_at", None)
    if path:
        drop_path(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within the block are deleted when it ends; what is to last must have been written
    elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_path(spark, path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark itself resolves it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + out.removeprefix("file:") if out.startswith("file:/") and not out.startswith("file://") else out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged path through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
