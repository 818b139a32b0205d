"""Shared plumbing of the training-data operators: tables, written intermediates, byte helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import shared_dir

_WRITTEN: dict[str, list[str]] = {}
_OWNER = [""]
#: Rows of a few numbers or short keys that go to one file, where their number is known.
FILE_ROWS = 1 << 16
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table through Spark, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    A table of up to ``rows`` narrow rows is written by a task for each FILE_ROWS of them, however many
    partitions it has: each file costs requests to the store, or processes where that is a local disk.
    The folder goes with ``discard``, with ``release`` of its owner, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    _WRITTEN.setdefault(_OWNER[-1], []).append(path)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames. Call it once all that reads them has been written."""
    for df in frames:
        path = _FOLDERS.pop(df)
        for written in _WRITTEN.values():
            if path in written:
                written.remove(path)
        fs, p = _hadoop(df.sparkSession, path)
        fs.delete(p, True)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """What is materialised inside belongs to ``owner``, and goes when ``release`` is called for it."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def release(spark: SparkSession, owner: str) -> None:
    """Delete what was written for ``owner``. Call it only when no frame built on it is still to be read."""
    for path in _WRITTEN.pop(owner, []):
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


def unused(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Have Spark hand over whole texts in Arrow batches of at most ``rows`` rows that end once they hold ``size`` bytes, so that long texts fit in memory.

    Spark reads these settings when the plan runs, so they stay set for the session; smaller ones are left alone.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        found = spark.conf.get(key, None) or "0"
        if not (found.isdigit() and 0 < int(found) <= most):
            spark.conf.set(key, str(most))


def trim() -> None:
    """Give memory that Arrow and the C library hold free back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a Python worker, which Spark keeps for later tasks, gives its free memory back."""

    @wraps(run)
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            trim()

    return call
