"""What Python workers give back after a task.

Spark uses Python workers again, for the next stage as well, and may have more of them than cores. Allocators keep what
a task has freed, so several workers that sit idle hold the largest batch and tables each of them ever had.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(scan: Scan) -> Scan:
    """A scan for ``mapInArrow`` after which the worker returns unused memory to the system."""

    @functools.wraps(scan)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            release()

    return run


def release() -> None:
    """Return memory that Arrow's pool and the C library keep for later; only glibc has ``malloc_trim``."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
