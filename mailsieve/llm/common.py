"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from mailsieve.session import materialize, scratch_path

__all__ = ["batches_of", "byte_slices", "discard", "drop_shuffles", "input_mb", "keep_only", "materialize", "release", "scratch_path", "small_batches", "table", "text_slices"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_only(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the input carries."""
    return df.select(*[df[c] for c in columns])


def input_mb(df: DataFrame) -> float:
    """Size estimate of a frame in MB, from the optimizer's statistics."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return float(str(stats.sizeInBytes())) / 1e6


def text_slices(batch: pa.RecordBatch, column: str, max_chars: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows of a batch; a null text is empty.

    A slice ends once it holds `max_chars`, so Python objects of a whole batch
    never exist at once; a longer text is a slice of its own.
    """
    values = batch.column(column)
    first, texts, held = 0, [], 0
    for i, value in enumerate(values):
        text = value.as_py() or ""
        texts.append(text)
        held += len(text)
        if held >= max_chars:
            yield first, texts
            first, texts, held = i + 1, [], 0
    if texts:
        yield first, texts


def release() -> None:
    """Give memory that a task has freed back to the system, for the worker process goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def byte_slices(column: pa.Array, max_bytes: int = 8_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, values) of consecutive rows of a string column that hold about `max_bytes`; a longer value is a slice of its own."""
    if len(column):
        held = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) // max_bytes
        firsts = np.flatnonzero(np.append(True, held[1:] != held[:-1])).tolist()
        for first, end in zip(firsts, [*firsts[1:], len(column)]):
            yield first, column.slice(first, end - first)


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote and nothing reads any more."""
    files = df.inputFiles()
    if files:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(conf).delete(folder, True)
    drop_shuffles(df.sparkSession)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Settings under which texts go to Python some rows at once: Spark's 10,000 take tens of MB in the executor and in the worker each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of queries that have ended: it does so when the driver's heap is collected, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def batches_of(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """mapInArrow function that turns each batch into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run
