"""Memory of Python workers. Workers are reused by later stages, so a task gives back what it took."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Caches that are cheap to fill again and are emptied when a partition ends.
PASSING: list[dict] = []


def trim() -> None:
    """Returns free memory to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator keeps what it keeps
        pass


def release() -> None:
    """Empties the passing caches and trims."""
    for cache in PASSING:
        cache.clear()
    trim()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A partition function that releases memory when its partition ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
