"""Bounds on what Python workers hold."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

# Bytes of an Arrow batch, where the session does not say.
BATCH_BYTES = 4 * 1024 * 1024


def release_memory() -> None:
    """Give memory that earlier tasks of this Python worker freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it has a bound of its own.

    By default a batch may hold 64 MB; the executor, the pipe and the Python worker each
    hold copies of it. A row longer than the bound is a batch by itself.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
