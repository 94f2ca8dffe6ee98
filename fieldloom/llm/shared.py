"""Working tables in the cluster's shared folder, and text columns read as Arrow buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one is made and set, on a local master only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's file system closes."""
    path = f"{shared_dir(spark)}/work/{name}-{uuid.uuid4().hex}"
    found, system = _hadoop(spark, path)
    system.deleteOnExit(found)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: short lineage that any executor can reread."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _hadoop(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    found, system = _hadoop(spark, path)
    system.delete(found, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` once nothing reads it any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, parent)


def whole_tables(spark: SparkSession, folder: str, name: str = "*") -> list[str]:
    """Names of the tables in a folder whose writing ended."""
    found, system = _hadoop(spark, f"{folder}/{name}/_SUCCESS")
    return [x.getPath().getParent().getName() for x in system.globStatus(found) or []]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes; a longer document is a range of its own."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, to
        at = to


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each document's values, added in their order: equal documents have equal sums wherever they stand."""
    n = len(first) - 1
    return np.bincount(np.repeat(np.arange(n), np.diff(first)), weights=values, minlength=n)


def returning(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches, which hands the memory that it freed back to the system at its end: Spark keeps workers for the tasks of later stages."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            hand_back()

    return run


def hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)
