"""What a Python worker keeps from task to task, and how it reads texts: little of both.

Spark deals the tasks of all stages to the same workers, so what one operator leaves in a worker's memory
lies beside the next one's. A worker therefore holds the state of one operator at a time; and of an Arrow
batch only a block of texts of bounded size is held as Python objects.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in one block, about; a longer text is a block of its own.
BLOCK_BYTES = 500_000

_held: tuple[tuple, Any] | None = None


def state(key: tuple, make: Callable[[], Any]) -> Any:
    """This worker's state of ``key``, made once; that of another key goes first, and its memory back to the system."""
    global _held
    if _held is None or _held[0] != key:
        if _held is not None:
            _held = None
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # a C library without it
        _held = (key, make())
    return _held[1]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts in UTF-8) of consecutive rows of ``column`` of about ``size`` bytes together; null is empty."""
    if not len(column):
        return
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield a, [x or b"" for x in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
