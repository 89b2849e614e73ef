"""Helpers that the corpus operators share: bounded Arrow batches, scratch tables in the
folder that driver and executors share, and flat numpy views of Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import glob
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import drop, materialize, scratch_path  # noqa: F401

#: Rows in an Arrow batch: documents may be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch, unless the session has its own setting below the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another number of rows in an Arrow batch, for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark resolves it by, so that workers open the same file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def least_hash_rows(rows: DataFrame, by: str, sample: int, key: str = "doc_id") -> DataFrame:
    """Of each value of `by` the `sample` rows whose key has the least hash.

    A filter by the counts first leaves about twice that many, so no task ranks a large group.
    """
    place = (F.xxhash64(key) / F.lit(2.0**64) + 0.5).alias("_place")
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))  # a row for each value
    some = rows.select("*", place).join(F.broadcast(counts), by).where(F.col("_place") <= 2.0 * sample / F.col("_n"))
    order = Window.partitionBy(by).orderBy("_place", key)
    return some.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).select(*rows.columns)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_parts(df: DataFrame, least: int = 32, most: int = 20_000, each: int = 1) -> int:
    """A number of hash buckets that follows the input: `each` for a scan task, within limits."""
    return max(least, min(most, each * df.rdd.getNumPartitions()))


def salted(x: DataFrame, y: DataFrame, rows: int, each: int) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join of few small rows whose keys may hold most of them, with a salt in the key: about `each`
    rows of x have one salt, and y is there once for each, so no task holds all pairs of a key."""
    salts = -(-max(rows, 1) // each)
    left = x.withColumn("salt", F.pmod(F.xxhash64(*x.columns), F.lit(salts)).cast("int"))
    return left, y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def pieces(batch: pa.RecordBatch | pa.Array, column: str | None = None, most: int = 1 << 21) -> Iterator[pa.Array]:
    """Slices of a batch that hold about `most` bytes of text; a longer text is alone in its slice."""
    text = batch if column is None else batch.column(column)
    off = offsets(text)
    i, n = 0, len(text)
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + most, "right")) - 1, i + 1), n)
        yield batch.slice(i, j - i)
        i = j


def offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    return np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)


def flat_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column as one array, and the offsets of its rows (a null is empty)."""
    off = offsets(text)
    data = text.buffers()[2] if len(text) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def trim() -> None:
    """Give free memory back to the system: a worker that waits for its next task should be small."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(_libc := ctypes.CDLL(None), "malloc_trim"):
        _libc.malloc_trim(0)


@functools.cache
def one_thread() -> None:
    """Let numpy's bundled linear algebra use one thread in this process: a task owns one core, and idle helpers spin."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        if held := getattr(ctypes.CDLL(path), "scipy_openblas_set_num_threads64_", None):
            held(1)


def squeeze(ascending: np.ndarray) -> bytes:
    """Ascending uint64 values as the byte planes of their differences, whose high planes compress to nothing."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... of `lengths[0]` items, then those of the next run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
