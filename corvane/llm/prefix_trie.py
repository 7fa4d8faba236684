"""Conversation prefix trie: which conversations begin alike, how deep, and what sharing saves.

A node is a distinct sequence of first turns (role, text); its owner is the smallest
conversation that begins with it.  The steps:

1. Turns are known by a 64-bit hash.  Rows of equal hash are compared by text, as the
   least and the greatest (role, text) of each hash in one aggregate that combines before
   the shuffle; hashes whose texts differ are numbered apart.
2. Turns are put in order by a sort across partitions.  Each sorted partition is one numpy
   scan: place in the conversation, polynomial prefix fingerprint (the sum of turn hash
   times base^depth, modulo 2^64) and text length so far.  What a partition knows of its
   last conversation is carried to the next ones (one row a partition), so a
   conversation may span any number of partitions.
3. Rows of equal (depth, fingerprint) are a candidate group.  Each row's turn and the
   fingerprint before it are compared with those of the group's representative (again
   least against greatest); by induction over depth, equal pairs everywhere mean equal sequences.  The members
   of a group that differ get salts, and fingerprints are made again until all groups hold.
4. A conversation owns the deep end of its path, from where it leaves an older one.  So
   what a subtree holds is the sum over its member conversations, and one aggregate rolls
   children, leaves and saved tokens up to every parent at once, however deep the trie.

Hot keys: a node that a third of all conversations share is aggregated by blocks of
conversations first, and its owner goes back to the members through these blocks; what
belongs to a conversation reaches its rows by blocks of depth.  The ids that end at a
node are joined in sorted chunks, and only the chunks' text goes through the digest.

Defined cases: null role and text are empty; rows without conv_id belong to no
conversation and are left out; turns are ordered by turn, nulls first, ties by role and
then by the MD5 of the text; repeated rows are repeated turns; a very long text counts
once, as a hash and a length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import ship
from corvane.llm.common import Workspace

#: Base of the fingerprints; odd.
BASE = 0x9E3779B97F4A7C15
#: Blocks of conversations in which a node is aggregated first, and turns in a block of depth.
NODE_BLOCKS, DEPTH_BLOCK = 4096, 4096
#: Conversation ids in a chunk of those that end at a node.
CHUNK_IDS = 1 << 15
#: Turns that may come from another conversation, and the conversations that share a source.
HEAD_TURNS, FAMILY = 5, 100

_SCANNED = "part int, closing boolean, conv_id long, first_id long, nth long, fp long, cum long, last boolean, hash long, again long, salt long, chars long"
_PATH = "conv_id long, depth long, fp long, before long, cum long, last boolean, hash long, again long, salt long, chars long"


def _powers(n: np.ndarray) -> np.ndarray:
    """BASE^n modulo 2^64."""
    out, square, left = np.ones(len(n), np.uint64), np.uint64(BASE), n.astype(np.uint64)
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & np.uint64(1), out * square, out)
            square, left = square * square, left >> np.uint64(1)
    return out


def _turn_value(hashes: np.ndarray, again: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The number that stands for a turn in the polynomial; a root row (null hash) has none."""
    x = hashes.astype(np.int64).view(np.uint64) + again.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt.astype(np.int64).view(np.uint64)
    return x


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def scan(ordered: DataFrame) -> DataFrame:
    """Places, fingerprints and lengths of rows (conv_id, hash, again, salt, chars) in their order, within each partition.

    Each partition ends with a closing row of its last conversation: the sums so far.
    """
    ship(ordered.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, held = TaskContext.get().partitionId(), None, None
        conv, nth, fp, cum = None, 0, np.uint64(0), 0

        def batch(closing, ids, first_ids, n, f, c, last, *rest):
            k = len(ids)
            cols = [pa.array(np.full(k, part, np.int32)), pa.array(np.full(k, closing)), pa.array(ids), pa.array(first_ids), pa.array(n), pa.array(f.view(np.int64)), pa.array(c), pa.array(last), *map(pa.array, rest)]
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCANNED.split(", ")])

        for given in batches:
            if not given.num_rows:
                continue
            ids, h, again, salt, chars = _columns(given, "conv_id", "hash", "again", "salt", "chars")
            first = ids[0] if first is None else first
            if held is not None:  # whether its last row ends a conversation is known now
                held[5][-1] = ids[0] != held[0][-1]
                yield batch(False, *held)
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            sizes = np.diff(np.append(starts, len(ids)))
            lead = nth if ids[0] == conv else 0
            local = np.arange(1, len(ids) + 1) - np.repeat(starts, sizes)
            local[: sizes[0]] += lead
            with np.errstate(over="ignore"):
                sums = np.cumsum(_turn_value(h, again, salt) * _powers(local), dtype=np.uint64)
                shift = np.concatenate(([np.uint64(0)], sums))[starts]
                fps = sums - np.repeat(shift, sizes)
                lengths = np.cumsum(chars)
                cums = lengths - np.repeat(np.concatenate(([0], lengths))[starts], sizes)
                if lead:
                    fps[: sizes[0]] += fp
                    cums[: sizes[0]] += cum
            last = np.concatenate((ids[1:] != ids[:-1], [True]))
            held = [ids, np.full(len(ids), first), local, fps, cums, last, h, again, salt, chars]
            conv, nth, fp, cum = ids[-1], local[-1], fps[-1], cums[-1]
        if held is not None:
            yield batch(False, *held)
            one, zero = np.ones(1, bool), np.zeros(1, np.int64)
            yield batch(True, *(np.array([x]) for x in (conv, first, nth)), np.array([fp], np.uint64), np.array([cum]), one, zero, zero, zero, zero)

    return ordered.select("conv_id", "hash", "again", "salt", "chars").mapInArrow(run, _SCANNED)


def carried(scanned: DataFrame) -> DataFrame:
    """conv_id, depth (1, 2, ...), fp, the fp before, cum and last of scanned rows, with what earlier partitions hold of their conversation."""
    ends = scanned.where("closing").select("part", "first_id", "conv_id", "nth", "fp", "cum").orderBy("part").collect()  # one row a partition
    known, goes_on, held = {}, set(), None
    for k, e in enumerate(ends):
        n, fp, cum = e.nth, e.fp % (1 << 64), e.cum
        if held is not None and held[0] == e.first_id:
            known[e.part] = held
            if e.conv_id == e.first_id:
                n, fp, cum = n + held[1], (held[2] + pow(BASE, held[1], 1 << 64) * fp) % (1 << 64), cum + held[3]
        held = (e.conv_id, n, fp, cum)
        if k + 1 < len(ends) and ends[k + 1].first_id == e.conv_id:
            goes_on.add((e.part, e.conv_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, ids, nth, fp, cum, last, h, again, salt, chars = _columns(batch, "part", "conv_id", "nth", "fp", "cum", "last", "hash", "again", "salt", "chars")
            nth, fp, cum, last = nth.copy(), fp.astype(np.int64).view(np.uint64).copy(), cum.copy(), last.astype(bool).copy()
            with np.errstate(over="ignore"):
                for part in np.unique(parts):
                    if part in known:
                        conv, n, f, c = known[part]
                        at = np.flatnonzero((parts == part) & (ids == conv))
                        nth[at] += n
                        fp[at] = np.uint64(f) + np.uint64(pow(BASE, n, 1 << 64)) * fp[at]
                        cum[at] += c
                    for conv in ids[(parts == part) & last][-1:]:
                        if (int(part), int(conv)) in goes_on:
                            last[np.flatnonzero((parts == part) & (ids == conv) & last)] = False
                before = fp - _turn_value(h, again, salt) * _powers(nth)
            cols = [ids, nth, fp.view(np.int64), before.view(np.int64), cum, last, h, again, salt, chars]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in _PATH.split(", ")])

    return scanned.where("not closing").mapInArrow(run, _PATH)


def known_turns(conversations: DataFrame, work: Workspace, turn_hash: Callable[[Column, Column], Column] = F.xxhash64) -> DataFrame:
    """conv_id, turn, role, tie, hash, again, chars: turns by a hash, of which those with other texts are numbered apart."""
    given = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = given.withColumn("hash", turn_hash(F.col("role"), F.col("text")).cast("long"))
    said = F.struct("role", "text")
    mixed = work.write(rows.groupBy("hash").agg(F.min(said).alias("least"), F.max(said).alias("greatest")).where("least <> greatest").select("hash"), "mixed")
    again = F.lit(0).cast("long")
    if not mixed.isEmpty():
        # Only rows of hashes that more than one text has.
        texts = rows.join(mixed, "hash", "left_semi").select("hash", "role", "text").distinct()
        numbers = texts.groupBy("hash").agg(F.array_sort(F.collect_list(said)).alias("said")).select("hash", F.posexplode("said").alias("number", "said")).select("hash", "said.role", "said.text", "number")
        rows = rows.join(work.write(numbers, "numbers"), ["hash", "role", "text"], "left")
        again = F.coalesce("number", again).cast("long")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("tie"), "hash", again.alias("again"), F.length("text").cast("long").alias("chars"))


def ordered_turns(turns: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, depth (place from 1), hash, again, chars of all turns."""
    keyed = turns.select("*", F.lit(0).cast("long").alias("salt"), F.monotonically_increasing_id().alias("row"))
    in_order = keyed.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "tie", "hash", "again", "row")
    return work.write(carried(work.write(scan(in_order), "sorted")).select("conv_id", "depth", "hash", "again", "chars"), "turns")


def rebuilt_turns(placed: DataFrame, head_turns: int = HEAD_TURNS, family: int = FAMILY) -> DataFrame:
    """conv_id, place, hash, again, chars: a root row (place 0), the first h turns of the family's source, then a conversation's own after its first h."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % (head_turns + 1)).cast("long")
    turn = F.struct(F.col("depth").alias("place"), "hash", "again", "chars")
    # At most head_turns turns of a source, which at most `family` conversations ask for.
    sources = placed.where((c % family == 0) & (F.col("depth") <= head_turns)).groupBy(c.alias("source")).agg(F.array_sort(F.collect_list(turn)).alias("heads"))
    convs = placed.where("depth = 1").select("conv_id", (c - c % family).alias("source"), h.alias("h"))
    zero = F.lit(0).cast("long")
    root = F.array(F.struct(zero.alias("place"), zero.alias("hash"), zero.alias("again"), zero.alias("chars")))
    heads = F.filter(F.coalesce("heads", F.array().cast("array<struct<place:bigint,hash:bigint,again:bigint,chars:bigint>>")), lambda t: t["place"] <= F.col("h"))
    led = convs.join(sources, "source", "left").select("conv_id", F.explode(F.concat(root, heads)).alias("t")).select("conv_id", "t.*")
    own = placed.where(F.col("depth") > h).select("conv_id", F.col("depth").alias("place"), "hash", "again", "chars")
    return led.unionByName(own)


def _masked(paths: DataFrame, bits: int) -> DataFrame:
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")
    return paths.select("*", F.col("fp").bitwiseAND(mask).alias("m"), F.col("before").bitwiseAND(mask).alias("b")).drop("fp", "before").withColumnsRenamed({"m": "fp", "b": "before"})


def verified_paths(rebuilt: DataFrame, work: Workspace, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows of all paths, nodes by block of conversations), after groups of equal fingerprints were verified and split.

    ``bits``: width of the fingerprints in the first round; later ones, after collisions, are of 64 bits.
    """
    turn = F.struct("before", "hash", "again")
    rows = work.write(rebuilt.withColumn("salt", F.lit(0).cast("long")), "rebuilt")
    for k in range(64):
        scanned = work.write(scan(rows.orderBy("conv_id", "place")), f"scan{k}")
        block = F.pmod(F.xxhash64("conv_id"), F.lit(NODE_BLOCKS)).cast("int")
        # A root row is a conversation's first, so depths begin at 0.
        paths = _masked(carried(scanned).withColumn("depth", F.col("depth") - 1).withColumn("block", block), bits if k == 0 else 64)
        paths = work.write(paths, f"paths{k}")
        parts = paths.groupBy("depth", "fp", "block").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.count_if("last").alias("n_last"), F.min(turn).alias("least"), F.max(turn).alias("greatest"))
        parts = work.write(parts, f"parts{k}")
        nodes = parts.groupBy("depth", "fp").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
        mixed = work.write(nodes.where("least <> greatest").select("depth", "fp"), f"mixed{k}")
        if mixed.isEmpty():
            return paths, parts
        kinds = paths.join(mixed, ["depth", "fp"], "left_semi").select("depth", "fp", "before", "hash", "again").distinct()
        numbers = kinds.groupBy("depth", "fp").agg(F.array_sort(F.collect_list(turn)).alias("kinds")).select("depth", "fp", F.posexplode("kinds").alias("kind", "t")).select("depth", "fp", "t.*", "kind").where("kind > 0")
        joined = paths.join(work.write(numbers, f"kinds{k}"), ["depth", "fp", "before", "hash", "again"], "left")
        salt = F.when(F.col("kind").isNotNull(), F.xxhash64("salt", "kind", F.lit(k))).otherwise(F.col("salt"))
        rows = work.write(joined.select("conv_id", F.col("depth").alias("place"), "hash", "again", "chars", salt.alias("salt")), f"salted{k}")
    raise RuntimeError("fingerprints still collide")


def ends_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of rows (owner, depth, conv_id): SHA-256 of the ids, ascending and comma-joined."""
    ship(ends.sparkSession)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, depth, conv = _columns(batch, "owner", "depth", "conv_id")
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])))) if len(owner) else []
            cuts = [a + k for a, b in zip(new, [*new[1:], len(owner)]) for k in range(0, b - a, CHUNK_IDS)]
            texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(owner)])]
            yield pa.RecordBatch.from_arrays([pa.array(owner[cuts] if cuts else []).cast(pa.int64()), pa.array(depth[cuts] if cuts else []).cast(pa.int64()), pa.array(conv[cuts] if cuts else []).cast(pa.int64()), pa.array(texts, pa.string())], names=["owner", "depth", "first_id", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["owner", "depth", "ends_sha256"])

        for batch in batches:
            done = []
            for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
                if (owner, depth) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield out(done)
        if key is not None:
            yield out([(*key, state.hexdigest())])

    joined = ends.orderBy("owner", "depth", "conv_id").mapInArrow(chunks, "owner long, depth long, first_id long, ids string")
    return joined.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first_id").mapInArrow(digests, "owner long, depth long, ends_sha256 string")


def roll_up(paths: DataFrame, parts: DataFrame, work: Workspace) -> DataFrame:
    """One row a node, from all paths and the nodes by block."""
    node = parts.groupBy("depth", "fp").agg(F.min("owner").alias("owner"), (F.sum("n") == F.sum("n_last")).alias("leaf"))
    back = parts.select("depth", "fp", "block").join(node, ["depth", "fp"])
    owned = work.write(paths.join(back, ["depth", "fp", "block"]).select("conv_id", "depth", "owner", "leaf", "chars", "cum", "last"), "owned")
    mine = F.col("conv_id") == F.col("owner")
    # Where a conversation leaves the older ones: the deepest node of its path that isn't its own.
    leaves_at = F.max(F.when(~mine, F.struct("depth", "cum", "owner")))
    convs = owned.groupBy("conv_id").agg(F.max("depth").alias("size"), leaves_at.alias("at"), F.bool_or(mine & F.col("last") & F.col("leaf")).alias("ends_leaf"))
    spread = convs.select("conv_id", "size", "ends_leaf", F.coalesce("at.depth", F.lit(-1)).alias("left_at"), F.coalesce("at.cum", F.lit(0)).alias("left_cum"), F.col("at.owner").alias("older"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / DEPTH_BLOCK))).alias("deep"))
    joined = owned.withColumn("deep", F.floor(F.col("depth") / DEPTH_BLOCK)).join(spread, ["conv_id", "deep"])
    depth, left_at = F.col("depth"), F.col("left_at")
    parent = F.when(mine & (depth > 0), F.when(depth - 1 > left_at, F.col("conv_id")).otherwise(F.col("older")))
    out = joined.groupBy("owner", "depth").agg(
        F.max(parent).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if((depth >= left_at) & (depth < F.col("size"))).alias("n_children"),
        F.count_if("ends_leaf").alias("n_leaves"),
        F.sum(F.when(depth <= left_at, F.col("left_cum") - (F.col("cum") - F.col("chars"))).otherwise(0)).alias("saved_tokens"),
    )
    ends = ends_digests(owned.where("last").select("owner", "depth", "conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.join(ends, ["owner", "depth"], "left").select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, work: Workspace, head_turns: int = HEAD_TURNS, family: int = FAMILY, turn_hash: Callable[[Column, Column], Column] = F.xxhash64, bits: int = 64) -> DataFrame:
    """The trie's nodes of conversations (conv_id, turn, role, text), rebuilt with the heads of their families' sources."""
    placed = ordered_turns(known_turns(conversations, work, turn_hash), work)
    paths, parts = verified_paths(rebuilt_turns(placed, head_turns, family), work, bits)
    return roll_up(paths, parts, work)
