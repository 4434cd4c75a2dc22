"""Size of the batches that Python workers get, and the memory that workers keep."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1_000


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """At most ``rows`` rows a batch from now on in this session: a batch of whole texts or sets is held by the JVM and
    by the worker at once, so the usual 10,000 rows may be hundreds of megabytes. Smaller settings stay."""
    now = int(spark.conf.get(_SETTING, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(_SETTING, str(rows))


def give_back() -> None:
    """Hands back to the system what this process has freed but keeps at hand."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)


def lean(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow``, that gives its memory back at the end. Workers outlive their tasks, and stand idle beside
    the JVM of the executor with all that their largest task took."""
    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
