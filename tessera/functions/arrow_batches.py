"""Arrow batches in Python workers: slices of bounded size, and memory given back after a task."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of content that a task turns into Python objects at a time.
SLICE_ROWS = 1000
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and, but for single long values, bytes of column."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(ends):
            before = int(ends[begin - 1]) if begin else 0
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(begin, end - begin)
            begin = end


def released(each):
    """each, a function over the batches of a task, after which the worker, which lives on, gives back its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # a library of another system has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run
