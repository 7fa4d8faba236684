"""Values of Arrow batches, one by one, for functions that need Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows of a batch that come out together.
STEP = 128


def give_back() -> None:
    """Returns what a task has freed to the machine: the worker stays for other tasks, next to the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def each_value(batches: Iterator[pa.Array], one: Callable[[pa.Scalar], object], kind: pa.DataType) -> Iterator[pa.Array]:
    """one(value) of every value, null of null.

    A batch is some thousands of rows, of any length: beside it, ``STEP`` of its results are held as Python objects,
    and of its values one.
    """
    for batch in batches:
        for i in range(0, len(batch), STEP):
            yield pa.array([one(v) if v.is_valid else None for v in batch.slice(i, STEP)], kind)
    give_back()
