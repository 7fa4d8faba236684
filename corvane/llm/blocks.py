"""Shuffles of numpy columns.

Rows of fixed-width numbers (and ragged lists of them) are dealt out to cells as
packed binary blocks, so the JVM moves a block instead of some thousand rows.  A
cell's blocks meet in one task, cell by cell.  Up to ``MANY`` cells there are ``CELLS`` of them for each
shuffle partition, so that little is in a worker at a time; beyond, one, so that blocks don't get too small.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvane import ship
from corvane.llm.common import give_back

SCHEMA = "cell int, block binary"
CELLS, MANY = 4, 4096
#: Bytes of blocks that go to the JVM at a time, and rows of a block.
BATCH_BYTES, BLOCK_ROWS = 2 << 20, 2048
_ARRAY = struct.Struct("<BI")
_KINDS = tuple(np.dtype(f"<{kind}{width}") for kind in "ui" for width in (1, 2, 4, 8))


def narrow(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the smallest type that holds them."""
    if x.dtype.kind != "u" or x.itemsize == 1 or not len(x):
        return x
    return x.astype(np.min_scalar_type(x.max()), copy=False)


def pack(columns: list[np.ndarray]) -> bytes:
    parts = []
    for x in map(narrow, columns):
        parts += [_ARRAY.pack(_KINDS.index(x.dtype), len(x)), x.tobytes()]
    return b"".join(parts)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        kind, n = _ARRAY.unpack_from(raw, at)
        at += _ARRAY.size
        out.append(np.frombuffer(raw, _KINDS[kind], n, at))
        at += n * _KINDS[kind].itemsize
    return out


def ragged_index(counts: np.ndarray, order: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Places of the lists' values when the lists are put into this order; start: where each list begins, if that is known."""
    if start is None:
        start = np.cumsum(counts) - counts
    taken = counts[order]
    ends = np.cumsum(taken)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    at += np.repeat(start[order] - (ends - taken), taken)
    return at


def joined(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The blocks' columns, one after another."""
    return [np.concatenate(x) for x in zip(*blocks, strict=True)]


def cells(spark: SparkSession) -> int:
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, min(CELLS * partitions, MANY))


def batch(cell: list[int], block: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(block, pa.binary())], names=["cell", "block"])


def deal(cell: np.ndarray, pick: Callable[[np.ndarray], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows by cell; ``pick`` gives the columns of the rows at these places."""
    if not len(cell):
        return
    order = np.argsort(cell, kind="stable")
    own = cell[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    at, held, size = [], [], 0
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
        for i in range(a, b, BLOCK_ROWS):
            at.append(int(own[a]))
            held.append(pack(pick(order[i : min(b, i + BLOCK_ROWS)])))
            size += len(held[-1])
            if size >= BATCH_BYTES:
                yield batch(at, held)
                at, held, size = [], [], 0
    if held:
        yield batch(at, held)


def by_cell(dealt: DataFrame, fn: Callable[[list[list[np.ndarray]]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """fn on the blocks of each cell."""
    ship(dealt.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for cell, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if cell != now and held:
                    yield from fn(held)
                    held = []
                now = cell
                held.append(unpack(block.as_buffer().to_pybytes()))
        if held:
            yield from fn(held)
        give_back()

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)
