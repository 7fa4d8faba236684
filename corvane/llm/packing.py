"""Best-fit packing of documents into sequences by exact-complement hashing.

Tokens are cut into pieces of at most ``capacity``; only the number of pieces of
each length (at most ``capacity`` counts) reaches the driver.  There the plan is
made on counts alone: for each length, from the longest, the gap that it leaves
is looked up in indexes of single lengths, sums of two and sums of three, and exact
combinations are consumed as often as the counts allow at once; none is refused
while the counts hold one.  What remains is
filled best-fit.  Each step uses up a length, so the plan has a few thousand
patterns whatever the corpus holds.  A piece then finds its place from its rank
among pieces of its length, which is counted per part and never in one task.

Defined cases: null text is empty (its ids are the end id alone); a document of
exactly the capacity is one piece; a very long one is cut as it is encoded; of lengths that fill a
gap alike those that are left most often come first, then the shorter; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Workspace
from corvane.llm.encoders import encoded, encoder

CAPACITY = 4096
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their packed ids; ``nth`` counts a part's pieces of the same length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, seen = TaskContext.get().partitionId(), encoder(vocabulary), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], enc.dtype).tobytes()
        step = capacity * enc.dtype.itemsize
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in encoded(batch, enc, end):
                for piece, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    n = len(own) // enc.dtype.itemsize
                    rows.append((doc_id, piece, piece * capacity, n, zlib.crc32(np.frombuffer(own, enc.dtype).astype("<u4").tobytes()), own, part, int(seen[n])))
                    seen[n] += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


#: Thirds that are looked at before the indexes are made anew.
REINDEX = 64


class _Counts:
    """Pieces left of each length, with indexes of the sums of two and of three lengths.

    Counts only fall, so an index may name a sum that is spent but never lacks
    one that can be had; it is made anew when a search under it ends in vain.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.capacity = capacity
        self._index()

    def _index(self) -> None:
        self.indexed = self.left > 0
        size = 1 << (2 * self.capacity + 1).bit_length()
        one = np.fft.rfft(self.indexed, size)
        self.pairs = np.fft.irfft(one * one, size)[: self.capacity + 1] > 0.5
        # Sums of three are those of a pair that is within the capacity and a third.
        self.triples = np.fft.irfft(np.fft.rfft(self.pairs, size) * one, size)[: self.capacity + 1] > 0.5

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.left[x]) // lengths.count(x) for x in lengths)

    def pair(self, total: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths of this sum that the counts allow beside the held ones; those used most often at once."""
        a = np.arange(1, total // 2 + 1)
        often = np.minimum(self.left[a], self.left[total - a])
        for i in np.argsort(-often, kind="stable") if len(a) else ():
            if not often[i]:
                break
            if self.times((*held, int(a[i]), total - int(a[i]))):
                return int(a[i]), total - int(a[i])
        return None

    def exact(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap exactly; None only if the counts hold no such lengths beside the held ones."""
        if self.left[gap] and self.times((*held, gap)):
            return (gap,)
        if self.pairs[gap] and (found := self.pair(gap, held)):
            return found
        if not self.triples[gap]:
            return None
        thirds = (np.flatnonzero(self.left[1 : gap - 1]) + 1)[::-1]
        for i, c in enumerate(thirds.tolist()):
            if i == REINDEX and not np.array_equal(self.indexed, self.left > 0):
                self._index()
            if self.pairs[gap - c] and self.times((*held, c)) and (found := self.pair(gap - c, (*held, c))):
                return (c, *found)
        if not np.array_equal(self.indexed, self.left > 0):
            self._index()
        return None

    def use(self, lengths: tuple[int, ...]) -> int:
        n = self.times(lengths)
        for x in lengths:
            self.left[x] -= n
        return n


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); every piece is in one."""
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a length is outside 1 to the capacity")
    have, patterns = _Counts(counts, capacity), []
    if have.left[capacity]:
        patterns.append(((capacity,), have.use((capacity,))))
    for length in range(capacity - 1, 0, -1):
        while have.left[length] and (found := have.exact(capacity - length, (length,))):
            patterns.append(((length, *found), have.use((length, *found))))
    for length in range(capacity - 1, 0, -1):
        while have.left[length]:
            held, gap = (length,), capacity - length
            while gap:
                if len(held) > 1 and (found := have.exact(gap, held)):
                    held, gap = (*held, *found), 0
                    break
                fits = np.flatnonzero(have.left[1 : gap + 1])[::-1] + 1
                best = next((x for x in fits.tolist() if have.times((*held, x))), None)
                if best is None:
                    break
                held, gap = (*held, best), gap - best
            patterns.append((held, have.use(held)))
    return patterns


def plan_runs(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): pieces of a length from this rank on go to the sequences from that one on."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, ranks.get(x, 0), sequence, offset))
            ranks[x] = ranks.get(x, 0) + times
            offset += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (written; without ids) with sequence_id and offset."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # At most one row a length, so at most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan_runs(plan_patterns(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = runs.value
        starts = table[:, 0] * (1 << 48) + table[:, 1]
        i = np.searchsorted(starts, length.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table[i, 2] + rank.to_numpy() - table[i, 1], "offset": table[i, 3]})

    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", "part", "nth")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces with ids, placements); the pieces are a written table."""
    work = work or Workspace(docs.sparkSession, "packing")
    pieces = work.write(token_pieces(docs, vocabulary, end_id, capacity), "pieces", "snappy")
    return pieces, place_pieces(pieces.drop("ids"), capacity)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed ids of each sequence; a sequence has at most ``capacity`` ids."""
    # A piece is known by its part and its number among the part's pieces of its length.
    key = ["part", "length", "nth"]
    joined = placed.select(*key, "sequence_id", "offset").join(pieces.select(*key, "ids"), key)
    whole = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return whole.select("sequence_id", F.expr("aggregate(x.ids, x'', (a, b) -> concat(a, b))").alias("ids"))
