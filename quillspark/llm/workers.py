"""What Python workers hold, and how rows reach them."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

#: Rows of an Arrow batch: enough for array operations, few enough for long texts.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_held: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """``make()`` once for all tasks of a worker; what another operator or model left there is let go first."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give freed memory back to the system, as workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: Any) -> DataFrame:
    """``mapInArrow`` in batches of at most BATCH_ROWS; sets the session's batch size, which bounds memory on both sides, unless it is lower."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= BATCH_ROWS:
        conf.set(_ROWS, BATCH_ROWS)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(released, schema)
