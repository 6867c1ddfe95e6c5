"""What the operators share: tables, staging and batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from annalist.session import scratch_path

#: Rows and bytes that one Arrow batch to a Python worker holds at most.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches sent to Python small, so that long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # Results of a step are staged, so its shuffle files can go when it has ended.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (see ``annalist.session.stage``), well compressed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; what it freed goes back to the system at its end, because the workers live on for other steps.

    At its start the worker drops what other steps kept by ``kept``.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


_kept: list = []


def kept(make: Callable):
    """``make`` whose results a worker keeps for the next tasks of its step."""
    _kept.append(lru_cache(maxsize=4)(make))
    return _kept[-1]


def drop_kept() -> None:
    """Let go of what other steps kept in this process."""
    if any(made.cache_info().currsize for made in _kept):
        for made in _kept:
            made.cache_clear()
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the system, where its libraries can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is empty."""
    return [t or "" for t in column.to_pylist()]


def byte_columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and where each starts (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``most`` bytes together, one row at least."""
    start = 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = max(end, start + 1)
        yield start, end
        start = end
