"""SimHash near-duplicates through covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the XXH64 of its word
shingles.  Fingerprints link at ``radius`` or fewer differing bits.  Candidates
come from covering masks: each of the 64 bits gets a non-zero vector of
radius + 1 bits, and for each non-zero vector v the mask keeps the bits whose
vector has an odd product with v.  The at most ``radius`` bits in which a linked
pair differs span less than the whole space, so some v is orthogonal to all of
them and its mask keeps only bits on which the pair agrees: every pair within the
radius shares a bucket in one of the 2^(radius+1) - 1 tables.

Only distinct fingerprints take part (copies share one, with its smallest
doc_id).  In each bucket all members are first linked to a leader where that is within the
radius, in ``ROUNDS`` rounds with another leader each; these linear many links are contracted
to components.  Then only pairs of different components in a bucket are compared.
Buckets of over ``SPLIT`` members are dealt out again by a second, and if need be a third, family of
covering masks, whose bits are added to the first's.  That keeps the
guarantee; the three together leave few bits free, so a bucket holds a few hundred fingerprints at most.

Components are found by contraction rounds on tables in the shared folder; no
links or fingerprints reach the driver.

Defined cases: null and empty texts, and texts of white space, have fingerprint
zero and link like any other; fewer words than a shingle form one shingle;
a very long text is hashed whole, its bits counted in steps; equal ids and fingerprints are one point;
repeated rows share a component; null doc_ids are passed over (a component
of null ids alone has a null component_id); an empty table gives no rows; other
columns are ignored, or kept by ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Workspace, free_names, hex64, map_batches, text_bytes

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Members of a bucket from which on it is dealt out again by the second masks.
SPLIT = 128
#: Rounds in which a bucket's members meet one leader only.
ROUNDS = 2
#: Orders in which the families give vectors to the 64 bits, as factors.
ORDERS = (1, 37, 23)
#: Shingles whose bits are unpacked at a time.
STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text, unsigned."""
    words = text.lower().split()  # A-Z and ASCII white space only: the text is bytes
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    begin = np.concatenate(([0], ends[:-1]))
    if len(words) > shingle:
        begin, ends = begin[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        begin, ends = begin[:1], ends[-1:]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begin.tolist(), (ends - 1).tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[i : i + STEP].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str = "fp", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with the fingerprint as a signed long."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, shingle, seed) for x in text_bytes(batch.column("text"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=schema.names)

    return map_batches(docs, run, schema)


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over these bit positions such that any ``radius`` of them are outside some mask."""
    size = 2 ** (radius + 1) - 1
    return [sum(1 << bit for k, bit in enumerate(bits) if ((k % size + 1) & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _array(masks: list[int]):
    return F.array(*[F.lit(_signed(x)).cast("long") for x in masks])


def _near(radius: int):
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= radius


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, comp) of all nodes in edges (a, b); comp is the smallest node of the component.

    Each round, every node is merged with its smallest neighbour or itself, and
    the edges between the merged nodes remain; the number of rounds is about the
    logarithm of the longest path.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = work.write(both, f"{name}-edges-0", "lz4")
    labels, k = None, 0
    while not both.isEmpty():
        best = work.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), f"{name}-best-{k}", "lz4")
        to_b = best.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        merged = both.join(best, "a").join(to_b, "b").where("to <> to_b").select(F.col("to").alias("a"), F.col("to_b").alias("b")).distinct()
        following = work.write(merged, f"{name}-edges-{k + 1}", "lz4")
        if labels is None:
            moved = best.select(F.col("a").alias("node"), F.col("to").alias("comp"))
        else:
            moved = labels.join(best.select(F.col("a").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = work.write(moved, f"{name}-labels-{k}", "lz4")
        work.drop(f"{name}-edges-{k}", f"{name}-best-{k}", *([f"{name}-labels-{k - 1}"] if k else []))
        both, k = following, k + 1
    if labels is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels


def mask_family(turn: int, radius: int) -> list[int]:
    """Covering masks of the 64 bits, with another vector for each bit in each family."""
    return covering_masks([i * ORDERS[turn] % 64 for i in range(64)], radius)


def link_fingerprints(points: DataFrame, work: Workspace, radius: int = RADIUS) -> DataFrame:
    """(fp, comp) of the distinct fingerprints ``points.fp`` (written) that have links; comp is the smallest fp, as a signed number."""
    bucket = ["mask", "key"]
    tables = points.select("fp", F.explode(_array(mask_family(0, radius))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    many = tables.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark sizes exploded rows by the table before them and would send them all through the driver.
    shared = work.write(tables.hint("merge").join(many, bucket), "buckets")
    labels = work.write(shared.select("fp").distinct().withColumn("comp", F.col("fp")), "labels-0", "lz4")
    held = shared.withColumn("comp", F.col("fp"))
    for k in range(ROUNDS):
        lead = held.groupBy(*bucket).agg(F.min(F.struct((F.col("fp") if k == 0 else F.xxhash64(F.lit(k), "fp")).alias("h"), "fp", "comp")).alias("lead"))
        lead = lead.select(*bucket, F.col("lead.fp").alias("fp_b"), F.col("lead.comp").alias("comp_b"))
        near = held.join(lead, bucket).where((F.col("comp") != F.col("comp_b")) & _near(radius))
        labels = _contracted(labels, near, work, f"star-{k}", k)
        # Buckets whose members are in one component by now need nothing more.
        labelled = held.drop("comp").join(labels, "fp")
        mixed = labelled.groupBy(*bucket).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select(*bucket)
        held = work.write(labelled.join(mixed, bucket), f"held-{k}", "lz4")
    # What is left in different components is compared pair by pair, large buckets in finer ones.
    rows, parts = held, []
    for turn in range(1, len(ORDERS)):
        # n counts a bucket's members, so it is never too small.
        parts.append(rows.where(F.col("n") <= SPLIT).select("fp", "comp", *bucket))
        finer = rows.where(F.col("n") > SPLIT).select("fp", "comp", F.col("mask").alias("first"), F.explode(_array(mask_family(turn, radius))).alias("more"))
        finer = finer.select("fp", "comp", F.col("first").bitwiseOR(F.col("more")).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
        sizes = finer.groupBy(*bucket).agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select(*bucket, "n")
        rows = work.write(finer.hint("merge").join(sizes, bucket), f"rows-{turn}", "lz4")
    parts.append(rows.select("fp", "comp", *bucket))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    other = every.select(F.col("fp").alias("fp_b"), F.col("comp").alias("comp_b"), *bucket)
    pairs = every.join(other, bucket).where((F.col("comp") < F.col("comp_b")) & _near(radius))
    labels = _contracted(labels, pairs, work, "rest", ROUNDS)
    work.drop("buckets", *(f"held-{k}" for k in range(ROUNDS)), *(f"rows-{k}" for k in range(1, len(ORDERS))))
    return labels


def _contracted(labels: DataFrame, pairs: DataFrame, work: Workspace, name: str, turn: int) -> DataFrame:
    """Labels (fp, comp) after the components comp and comp_b of the pairs have become one; written."""
    merged = components(pairs.select(F.col("comp").alias("a"), F.col("comp_b").alias("b")).distinct(), work, name)
    moved = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("fp", F.coalesce("to", "comp").alias("comp"))
    out = work.write(moved, f"labels-{turn + 1}", "lz4")
    work.drop(f"labels-{turn}")
    return out


def _components_of(fps: DataFrame, work: Workspace, radius: int) -> DataFrame:
    """(fp, comp, least: the component's smallest doc_id or null) of written (doc_id, fp) rows."""
    points = work.write(fps.groupBy("fp").agg(F.min("doc_id").alias("own")), "points", "lz4")
    linked = link_fingerprints(points.select("fp"), work, radius)
    held = points.join(linked, "fp", "left").select("fp", "own", F.coalesce("comp", "fp").alias("comp"))
    # Only components of several fingerprints need their members' ids brought together.
    least = points.join(linked, "fp").groupBy("comp").agg(F.min("own").alias("least"))
    return held.join(least, "comp", "left").select("fp", "comp", F.coalesce("least", "own").alias("least"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, work: Workspace | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    work = work or Workspace(docs.sparkSession, "simhash")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fps = work.write(with_fingerprint(own, "fp", shingle).select("doc_id", "fp"), "fingerprints", "lz4")
    out = fps.join(_components_of(fps, work, radius), "fp")
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_first(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, work: Workspace | None = None) -> DataFrame:
    """One document of each component: that of the smallest doc_id (of rows that repeat it, one), with all its columns."""
    work = work or Workspace(docs.sparkSession, "simhash-keep")
    (fp,) = free_names(docs, "fp")
    marked = work.write(with_fingerprint(docs, fp, shingle), "documents")
    fps = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"))
    return first_of(marked, fp, _components_of(fps, work, radius)).select(*docs.columns)


def first_of(marked: DataFrame, fp: str, comp: DataFrame) -> DataFrame:
    """One row of each component; marked: documents with their column fp (written), comp: (fp, comp, least) of all fp."""
    least, own = free_names(marked, "_id", "_own")
    fps = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"))
    # A component's rows with its smallest doc_id may still have several fingerprints, where an id is repeated.
    first = fps.join(comp, "fp").where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("comp").agg(F.min("fp").alias(own), F.first("least").alias(least))
    same = marked["doc_id"].cast("long").eqNullSafe(F.col(least)) & (marked[fp] == F.col(own))
    kept = marked.join(first.select(own, least), same).select(*[marked[c] for c in marked.columns])
    # Rows of one id and fingerprint only: the join has put them together.
    return kept.dropDuplicates(["doc_id", fp])
