"""Size of the batches that go between the JVM and Python."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_MB = 8
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let an Arrow batch of long texts hold ``BATCH_MB`` at most, in this session.

    An executor holds a few copies of a batch per task, outside of its heap and in Python; results don't depend on it.
    """
    spark.conf.set(_SETTING, f"{BATCH_MB}m")


def values(column: pa.Array, step: int = 256) -> Iterator:
    """Python values of a column, a few at a time."""
    for start in range(0, len(column), step):
        yield from column.slice(start, step).to_pylist()


def _release() -> None:
    """Give memory that is not in use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not there outside of glibc
        pass


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a task, which at its end leaves no free memory in its Python worker.

    Workers wait for later tasks; what they hold meanwhile is missing in the stages that need no Python.
    """

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _release()

    return task
