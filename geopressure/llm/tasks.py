"""What the Python tasks of the operators share: small batches, and memory handed back at their end.

A worker process serves one operator after the other; what it keeps adds to its executor's memory.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows that a task turns into Python objects at once.
ROWS = 512


def _hand_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Other C libraries than GNU's hand memory back by themselves.
        return


def whole(run: Callable) -> Callable:
    """A batch function that leaves no freed memory behind."""

    @functools.wraps(run)
    def kept(batches: Iterator[pa.RecordBatch], **parameters):
        _hand_back()
        yield from run(batches, **parameters)
        _hand_back()

    return kept


def lean(run: Callable) -> Callable:
    """A batch function that is given batches of ``ROWS`` rows and leaves no freed memory behind."""

    @functools.wraps(run)
    def small_first(batches: Iterator[pa.RecordBatch], **parameters):
        _hand_back()
        small = (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))
        yield from run(small, **parameters)
        _hand_back()

    return small_first
