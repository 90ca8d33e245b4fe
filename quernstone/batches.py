"""What bounds the memory of Python workers: small Arrow batches, and memory given back."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session already asks for fewer: texts are long, and both sides of the pipe hold a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = spark.conf.get(name).rstrip("b")
    if not asked.isdigit() or int(asked) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def lean(run):
    """A worker's generator that gives memory back to the system when its task ends: workers are used again, beside others that wait."""

    @functools.wraps(run)
    def outer(parts):
        try:
            yield from run(parts)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return outer
