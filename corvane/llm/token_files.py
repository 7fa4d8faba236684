"""Token-id files with Elias-Fano document boundaries.

A file set is a Parquet table of segments; each row's ``segment`` cell is one
self-contained binary segment.  Parquet is only the carrier: it gives Spark's
commit protocol and works in any store that Spark reads.  Layout of a segment,
all little-endian::

    magic "CVTI" | u16 version | u8 id bytes (2 or 4) | u8 0
    u64 documents | u64 documents without an id | u64 ids | i64 smallest document id
    Elias-Fano of the documents' end offsets | Elias-Fano of doc_id - smallest
    the ids, concatenated in document order

An Elias-Fano sequence of n values up to u takes about n * (2 + log2(u / n))
bits: the low bits are packed, the high bits are a unary bit vector with a
sampled select directory, so an offset is found without a 64-bit table.  Reading a
document, or all of them, goes through the directory: from the sampled set bit before a
value only the bits up to the next sampled one are looked at.

Defined cases: null text is empty (its ids are the end id alone); documents are
in ascending doc_id order, null ids first, ties in order of the text's hash, then of the text, so that
rows of one id are dealt out to several tasks; a very long text is a segment of its own; repeated
rows stay; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.encoders import encoded, encoder

MAGIC, VERSION = b"CVTI", 1
#: One of so many set bits is in the select directory.
SELECT_STEP = 256
#: A segment is closed at so many ids or documents; a longer document has one of its own.
SEGMENT_IDS, SEGMENT_DOCUMENTS = 1 << 20, 1 << 16
#: Numbers whose bits are unpacked at a time; a multiple of 8.
BITS_STEP = 1 << 13
SEGMENT_SCHEMA = "part int, seq int, documents long, ids long, base long, segment binary"
_HEADER = struct.Struct("<4sHBBQQQq")
_EF = struct.Struct("<QQB7x")


def _bits(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits each, packed."""
    if not width or not len(values):
        return b""
    places = np.arange(width, dtype=np.uint64)
    parts = (values[i : i + BITS_STEP] for i in range(0, len(values), BITS_STEP))
    return b"".join(np.packbits((x[:, None] >> places & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() for x in parts)


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: memoryview, high: memoryview, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        values = np.asarray(values, np.uint64)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        low = _bits(values & np.uint64((1 << width) - 1), width)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        packed = np.packbits(high, bitorder="little").tobytes()
        samples = ones[::SELECT_STEP].astype("<u4").tobytes()
        return _EF.pack(n, len(packed), width) + samples + packed + low

    @staticmethod
    def decode(raw: memoryview) -> tuple[EliasFano, memoryview]:
        """The sequence, and what follows it."""
        n, high_bytes, width = _EF.unpack_from(raw)
        a = _EF.size
        b = a + 4 * (-(-n // SELECT_STEP))
        c = b + high_bytes
        d = c + (n * width + 7) // 8
        return EliasFano(n, width, raw[c:d], raw[b:c], np.frombuffer(raw[a:b], "<u4")), raw[d:]

    def select(self, i: int) -> int:
        """The i-th value, from the directory's nearest set bit on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SELECT_STEP]), i % SELECT_STEP
        byte = at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little")
        return (one - i) << self.low_bits | (chunk >> (first & 7)) & ((1 << self.low_bits) - 1)

    def select_many(self, places: np.ndarray) -> np.ndarray:
        """The values at these places (ascending); each block of the directory is unpacked once."""
        places = np.asarray(places, np.int64)
        if not len(places):
            return np.zeros(0, np.int64)
        if places[0] < 0 or places[-1] >= self.n:
            raise IndexError(int(places[-1]))
        ones = np.empty(len(places), np.int64)
        block = places // SELECT_STEP
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(places)], strict=True):
            k = int(block[a])
            begin = int(self.samples[k]) >> 3
            end = (int(self.samples[k + 1]) >> 3) + 1 if k + 1 < len(self.samples) else len(self.high)
            found = np.flatnonzero(np.unpackbits(np.frombuffer(self.high[begin:end], np.uint8), bitorder="little")) + 8 * begin
            found = found[np.searchsorted(found, int(self.samples[k])) :]
            ones[a:b] = found[places[a:b] - k * SELECT_STEP]
        return (ones - places) << self.low_bits | self._low(places)

    def _low(self, places: np.ndarray) -> np.ndarray:
        """The low bits of the values at these places."""
        width, out = self.low_bits, np.zeros(len(places), np.int64)
        if not width:
            return out
        low = np.frombuffer(self.low, np.uint8)
        for i in range(0, len(places), BITS_STEP):
            at = places[i : i + BITS_STEP, None] * width + np.arange(width)
            bits = low[at >> 3] >> (at & 7).astype(np.uint8) & 1
            out[i : i + BITS_STEP] = bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))
        return out


def encode_segment(doc_ids: list[int | None], parts: list[bytes], dtype: np.dtype) -> bytes:
    """doc_ids ascending with nulls first; parts: the packed ids of each document."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // dtype.itemsize for x in parts], dtype=np.int64)
    head = _HEADER.pack(MAGIC, VERSION, dtype.itemsize, 0, len(parts), nulls, int(ends[-1]) if len(ends) else 0, least)
    return head + EliasFano.encode(ends) + EliasFano.encode(known.astype(np.uint64) - np.uint64(least & (2**64 - 1))) + b"".join(parts)


def decode_segment(raw: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """Document ids, end offsets and the ids of a segment."""
    magic, version, width, _, documents, nulls, ids, least = _HEADER.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token segment of this version")
    ends, rest = EliasFano.decode(memoryview(raw)[_HEADER.size :])
    known, rest = EliasFano.decode(rest)
    if ends.n != documents or known.n != documents - nulls:
        raise ValueError("the segment's counts differ")
    doc_ids = [None] * nulls + (known.select_many(np.arange(known.n)).astype(np.uint64) + np.uint64(least & (2**64 - 1))).astype(np.int64).tolist()
    return doc_ids, ends, np.frombuffer(rest, f"<u{width}", ids)


def token_segments(docs: DataFrame, vocabulary: str, end_id: int, segment_ids: int = SEGMENT_IDS, segment_documents: int = SEGMENT_DOCUMENTS) -> DataFrame:
    """Segments of all documents: ``part`` in doc_id order, ``seq`` within it, ``base`` ids before the segment in its part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        held = base = seq = 0

        def close() -> pa.RecordBatch:
            segment = pa.array([encode_segment(doc_ids, parts, enc.dtype)], pa.binary())
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "documents": [len(parts)], "ids": [held], "base": [base], "segment": segment})

        for batch in batches:
            for doc_id, ids in encoded(batch, enc, end):
                n = len(ids) // enc.dtype.itemsize
                if parts and (held + n > segment_ids or len(parts) >= segment_documents):
                    yield close()
                    base, seq, held, doc_ids, parts = base + held, seq + 1, 0, [], []
                doc_ids.append(doc_id)
                parts.append(ids)
                held += n
        if parts:
            yield close()

    # Rows of one id, or without one, may be a third of all: their texts' hashes and the parts that they come from tell them apart.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"), F.spark_partition_id().alias("_part"))
    order = F.col("doc_id").asc_nulls_first()
    ordered = own.repartitionByRange(order, "_hash", "_part").sortWithinPartitions(order, "_hash", "text").select("doc_id", "text")
    return ordered.mapInArrow(pack, SEGMENT_SCHEMA)


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from written segments."""
    # One row a Spark partition of the writer, so the broadcast side is bounded by the number of shuffle partitions.
    totals = segments.groupBy("part").agg(F.sum("ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    placed = segments.join(F.broadcast(before), "part").select((F.col("before") + F.col("base")).alias("first"), "segment")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, boundaries, ids = decode_segment(batch.column(1)[i].as_py())
                ends = boundaries.select_many(np.arange(boundaries.n))
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                first = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts + first), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64())})

    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")
