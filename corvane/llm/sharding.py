"""Minimax contiguous partition of documents into shards (law: bytes).

Equal texts stay together.  Groups of equal texts are ordered by a 64-bit hash of
the text; neighbours in that order that share the hash's first 18 bits are one
atom, so the driver sees at most 2^18 atom sizes whatever the corpus holds.  The
smallest feasible capacity is found by binary search, each candidate checked by
a greedy pass over the ordered atoms, and the atoms are cut under it, as evenly
as the check of the rest allows.  An atom larger
than an even share (a large group of copies) can't be split; it comes first in the
order and has a shard of its own, and the rest is divided among the other shards.

Slots are counted from sizes of sub-blocks (atom range and a salt for each
row), so neither a shard nor a group of copies is ranked in one task.

Defined cases: null text has no bytes and groups with the empty text; ties in a
block are ordered by doc_id; repeated rows stay and have slots of their own; a very long text counts
with all its bytes and is never read again; an
empty table gives no rows; other columns are ignored, or kept by ``write_shards``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Workspace

SHARDS, ROW_BYTES = 40, 16
ATOM_BITS, BLOCK_BITS, SALTS = 18, 10, 256


def greedy_cuts(prefix: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Cuts of the greedy pass (index of the first atom of each next shard), or None if the capacity doesn't suffice. prefix starts at 0."""
    cuts, at, n = [], 0, len(prefix) - 1
    while at < n:
        if len(cuts) == shards:
            return None
        to = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        if to == at:
            return None
        cuts.append(to)
        at = to
    return cuts


def even_cuts(prefix: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Cuts under a feasible capacity, each as near to an even share of what is left as the greedy check of the rest allows."""
    cuts, at, n = [], 0, len(prefix) - 1
    for left in range(shards, 0, -1):
        if at == n:
            break
        far = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        goal = prefix[at] + (prefix[n] - prefix[at]) / left
        to = int(np.searchsorted(prefix, goal))
        if to > at + 1 and goal - prefix[to - 1] < prefix[min(to, n)] - goal:
            to -= 1
        to = min(max(to, at + 1), far)
        # The greedy cut always leaves a feasible rest.
        if to < n and (left == 1 or greedy_cuts(prefix[to:], left - 1, capacity) is None):
            to = far
        cuts.append(to)
        at = to
    return cuts


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for which a contiguous partition into ``shards`` exists, and its cuts."""
    prefix = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    total = int(prefix[-1])
    if not total:
        return 0, []
    low, high = max(-(-total // shards), int(sizes.max())), total
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(prefix, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low, even_cuts(prefix, shards, low)


def plan_shards(atoms: np.ndarray, sizes: np.ndarray, shards: int) -> tuple[dict[int, int], list[int]]:
    """(atom -> shard of the atoms larger than an even share, last atom of each further shard but the last).  atoms ascend."""
    sizes = sizes.astype(np.int64)
    single: dict[int, int] = {}
    left, total = np.ones(len(sizes), bool), int(sizes.sum())
    for i in np.argsort(-sizes, kind="stable")[: shards - 1].tolist():
        if int(sizes[i]) * (shards - len(single)) <= total:
            break
        single[int(atoms[i])] = len(single)
        left[i] = False
        total -= int(sizes[i])
    atoms, sizes = atoms[left], sizes[left]
    _, cuts = minimax_cuts(sizes, shards - len(single))
    return single, [int(atoms[c - 1]) for c in cuts[:-1]]


def assign_shards(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES, work: Workspace | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _assigned(own, shards, row_bytes, work, []).drop("row")


def _assigned(docs: DataFrame, shards: int, row_bytes: int, work: Workspace | None, kept: list[str]) -> DataFrame:
    """The shard and slot of every row; row is a struct of the columns to keep."""
    work = work or Workspace(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + row_bytes).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        # Rows without an id, or of one id, may be a third of all.  What is written stays as it is.
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("salt"),
        (F.struct(*kept) if kept else F.lit(None).cast("int")).alias("row"),
    )
    sized = work.write(sized.withColumn("atom", F.shiftrightunsigned("key", 64 - ATOM_BITS).cast("int")), "sized")
    # At most 2^ATOM_BITS rows of 12 bytes.
    sums = sized.groupBy("atom").agg(F.sum("size").alias("size")).orderBy("atom").toPandas()
    single, ends = plan_shards(sums["atom"].to_numpy(), sums["size"].to_numpy(np.int64), shards)
    shard = F.lit(len(single))
    for end in ends:
        shard = shard + (F.col("atom") > end).cast("int")
    for atom, own in single.items():
        shard = F.when(F.col("atom") == atom, F.lit(own)).otherwise(shard)
    rows = sized.select("doc_id", "size", "text_crc32", "key", shard.cast("int").alias("shard"), F.shiftright("atom", ATOM_BITS - BLOCK_BITS).alias("block"), "salt", "row")
    block = ["shard", "block", "salt"]
    # At most 2^BLOCK_BITS * SALTS rows, and one more a cut: a few MB.
    counts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("block", "salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*block, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*block).orderBy("key", "doc_id", "text_crc32")) - 1
    ranked = rows.withColumn("nth", within).join(F.broadcast(before), block)
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), "row")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, row_bytes: int = ROW_BYTES, work: Workspace | None = None) -> None:
    """The documents' rows under shard=... folders, in slot order within each file; a column named shard or slot gives way to ours."""
    kept = [c for c in docs.columns if c.lower() not in {"shard", "slot"}]
    placed = _assigned(docs, shards, row_bytes, work, kept).select("row.*", "shard", "slot")
    placed.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
