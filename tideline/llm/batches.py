"""Arrow helpers: text columns as byte arrays, cut into slices of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 4 << 20
#: Bytes of rows that go to a worker at once, or one row; executors hold them outside their heaps, several times.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES for the session, unless it has a bound of its own. The bound stays, as frames are run after they were made."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def collect_garbage(spark: SparkSession) -> None:
    """Have executors collect their garbage, and so give the system the part of their heaps that they don't need; else a heap that one stage
    let grow stays beside the workers of the next. One task for each core, so that on an idle cluster every executor gets some."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("reflect('java.lang.System', 'gc')").collect()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets into them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay under the limit; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


#: What this worker process keeps from task to task, by what it is for and the file that it was made of.
_kept: dict[str, dict[str, object]] = {}


def kept(use: str, path: str, make: Callable):
    """make(path), once for each worker process, until a task begins that is ``tidied`` for another use."""
    own = _kept.setdefault(use, {})
    if path not in own:
        own[path] = make(path)
        give_back()
    return own[path]


def give_back() -> None:
    """To the system what is no longer needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def keep_only(use: str | None) -> None:
    if others := [u for u in _kept if u != use]:
        for u in others:
            del _kept[u]
        gc.collect()
        give_back()


def tidied(run: Callable, use: str | None = None) -> Callable:
    """run, which passes the batches of a task, and gives what it no longer needs back to the system at its end: workers outlive tasks, and
    several of them share an executor's memory. What the worker kept for any other use goes before."""

    @wraps(run)
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(use)
        try:
            yield from run(batches)
        finally:
            give_back()

    return passed
