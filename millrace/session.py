"""Shared storage for intermediate tables. Cuts go to the folder that driver and executors share, so that lost executors lose nothing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset and all runs in one process (tests), a folder of our own that goes when Python ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.millrace.scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.millrace.scratch", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors.

    Compressed with zstd, whose buffers are freed with each file; snappy's wait outside the heap for a garbage collection.
    """
    path = scratch_path(df.sparkSession, name)
    for made in _made:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: list[list[str]] = []


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go as it ends, not when the driver happens to collect its garbage: around queries whose result is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession, *but: str) -> Iterator[None]:
    """Tables that are stored inside go at the end, but for those of some names: for a long session, around an action that writes or collects its result."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield
    finally:
        _made[:] = [x for x in _made if x is not paths]
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for p in (p for p in paths if p.rsplit("/", 1)[1].rsplit("-", 1)[0] not in but):
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)


def hinted(df: DataFrame, most: int, rows: int | None = None) -> DataFrame:
    """Broadcast df only where its counted rows are within `most`; beyond, a shuffled join (with adaptive skew handling) is left to Spark."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
