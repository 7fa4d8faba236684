"""Shared helpers: work tables in the shared folder, text batches, word arrays."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane import ship
from corvane.functions.batches import give_back

#: Bytes of text that one step of a Python operator holds in numpy arrays at a time.
STEP_BYTES = 2 << 20
#: Spark's own switch: shuffle files go when the statement that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that a function of one batch is given at a time.
BATCH_BYTES = 8 << 20
#: Rows and bytes of a batch that goes to Python while a work table is written.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine the warehouse's where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return at.rstrip("/")


class Workspace:
    """Parquet work tables of one query, under the shared folder.

    A table is written once and read back, which cuts lineage and survives lost
    executors.  Tables still in use when the query's DataFrame is read stay until
    the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, "")

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def write(self, df: DataFrame, table: str, codec: str = "zstd") -> DataFrame:
        # What is read from now on is the table; rows go to Python in batches that fit a worker many times.
        wanted = {CLEANUP: "true"} | {k: str(v) for k, v in BATCH_LIMITS.items()}
        before = {k: self.spark.conf.get(k) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").option("compression", codec).parquet(self.path(table))
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.read(table, df.schema)

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._remove(f"/{table}")

    def _remove(self, tail: str) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.base + tail)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended already; the tables are then left to the folder's owner
            pass


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it (by any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def steps(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together (a longer row is a range of its own)."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def text_steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 bytes of the texts) of ranges of rows of at most ``limit`` bytes together; null is empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in steps(sizes, limit):
        yield a, text_bytes(column.slice(a, b - a))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch, of about ``BATCH_BYTES`` at most (or one row)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(BATCH_BYTES, batch.nbytes))
            for i in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(i, rows))) is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def word_stream(parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of texts whose separators are already spaces (or ASCII white space).

    Returns all words in one flat array, and the n + 1 offsets of the texts in it.
    """
    if not parts:
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    texts = pa.array(parts, pa.large_binary()).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    if len(lengths) and not lengths.all():  # leading or trailing white space gives empty pieces
        keep = lengths > 0
        before = np.concatenate(([0], np.cumsum(keep)))
        flat, offsets = flat.filter(pa.array(keep)), before[offsets]
    return flat, offsets


#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
PLAIN_WORDS = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256)
)


def sequential_segments(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of these sizes."""
    total = int(counts.sum())
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total, dtype=np.int64) - starts


def hex64(column):
    """16 lower-case hex digits of a long, as unsigned."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


#: Bits of a Bloom filter's address.
BLOOM_BITS = 24


class Bloom:
    """A bit map of fixed size; membership may be wrong only by saying yes."""

    def __init__(self, values: DataFrame, column: str):
        at = F.shiftrightunsigned(F.xxhash64(column), 64 - BLOOM_BITS)
        word = F.shiftright(at, 6)
        bit = F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))")
        # At most 2^(BLOOM_BITS - 6) rows.
        found = values.select(at.alias("at"), word.cast("int").alias("word")).groupBy("word").agg(bit.alias("bits")).toArrow()
        self.words = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.words = self.words.view(np.uint64)

    def used(self) -> int:
        """Bits that are set: about the number of distinct values while that is far below the filter's size."""
        return int(np.bitwise_count(self.words).sum())

    def has(self, values: np.ndarray) -> np.ndarray:
        """values: signed longs."""
        at = hash_longs(values)
        at >>= np.uint64(64 - BLOOM_BITS)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def hash_longs(values: np.ndarray) -> np.ndarray:
    """XXH64 with seed 42 of 8-byte values, as Spark's xxhash64 has it for longs."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    with np.errstate(over="ignore"):
        h = np.full(len(values), np.uint64(42) + p5 + np.uint64(8))
        h ^= turn(values.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return h ^ h >> np.uint64(32)
