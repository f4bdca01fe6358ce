"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from inspect import isgeneratorfunction, signature

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a command deletes its shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows and bytes that one Arrow batch brings to a Python worker. Documents may be very long.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read with small Arrow batches from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the one that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing, a session on one machine gets a temporary folder of its own; on a cluster
    that would be a folder nobody else sees, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="archivist-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def gives_back(run: Callable) -> Callable:
    """A function of mapInArrow, or of one group or two, after which a Python worker, which Spark keeps for later tasks, returns the memory that is free in it."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)  # of glibc

    @wraps(run)
    def mapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    @wraps(run)
    def grouped(group):
        try:
            return run(group)
        finally:
            trim()

    @wraps(run)
    def cogrouped(left, right):
        try:
            return run(left, right)
        finally:
            trim()

    return mapped if isgeneratorfunction(run) else cogrouped if len(signature(run).parameters) == 2 else grouped


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind; the caller's setting comes back after it."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: later steps don't run this plan twice,
    and a lost executor loses none of it. The shuffles behind the rows are needed no more, so their files go."""
    path = shared_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Rows of a few numbers that are worth a task.
ROWS_A_TASK = 50_000


def sized(step: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored step in as many partitions as its rows are worth; on what fits one, later steps need no shuffle."""
    out = step.coalesce(-(-(step.count() if rows is None else rows) // ROWS_A_TASK) or 1)
    out.stored_at = step.stored_at
    return out


def free(*steps: DataFrame | None) -> None:
    """Delete what stored() wrote for steps that nothing reads any more."""
    for df in steps:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as keep it apart from the columns there are."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in there:
            n += "_"
        out.append(n)
    return out
