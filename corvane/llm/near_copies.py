"""Near copies of documents: Jaccard similarity of word shingles, MinHash bands and verification.

Texts whose sets of five-word shingles have a Jaccard similarity of at least
``SIMILARITY`` are linked, and of each component one document stays.  A
fingerprint of 64 bits can't decide this: at 0.8 a pair differs in about 10 bits.

Candidates are texts that agree on all ``ROWS`` minima of one of ``BANDS`` bands.
A pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS, which
is 5e-8 at 0.8 and less above it; that is the only recall given up.  Every
candidate is verified on the shingles themselves, so no pair below the threshold
is linked.

Only distinct texts (A-Z lower-cased, white space evened) take part.  In ``ROUNDS``
star rounds each member of a bucket is compared with one leader only, another one
each time; linked texts are contracted to components.  Then all pairs of a bucket
that are still in different components are compared, so a large group of near
copies costs linear work unless its members remain apart.

Shingles and texts are known by 64-bit hashes.  Defined cases: null and empty texts,
and texts of white space, are one text; fewer words than a shingle form one
shingle; a very long text is one step of its own and counts whole; repeated rows share a component; an empty table gives no rows; other
columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Bloom, Workspace, free_names, map_batches, sequential_segments, steps, text_bytes
from corvane.llm.line_dedup import _spread, word_hashes
from corvane.llm.simhash import components, first_of, link_fingerprints, with_fingerprint

SIMILARITY, SHINGLE = 0.8, 5
BANDS, ROWS = 32, 4
#: Rounds in which a bucket's members meet one leader only.
ROUNDS = 2
#: Bytes of text whose shingles are in arrays at a time.
STEP_BYTES = 1 << 18

_ODD = _spread(np.arange(1 << 12, (1 << 12) + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
_FLIP = _spread(np.arange(1 << 13, (1 << 13) + BANDS * ROWS, dtype=np.uint64))


def shingle_hashes(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every shingle of the texts, and the texts' offsets."""
    words, ends = word_hashes(texts)
    n_words = np.diff(ends)
    counts = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(ends[:-1], counts) + sequential_segments(counts)
    stop = np.repeat(ends[1:], counts)
    total = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(_spread(np.arange(shingle, dtype=np.uint64)) | np.uint64(1)):
        inside = at + k < stop
        total[inside] += words[at[inside] + k] * factor
    return _spread(total), offsets


def band_keys(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The ``BANDS`` keys of each text; none for a text without a word."""
    h, offsets = shingle_hashes(texts, shingle)
    some = np.flatnonzero(np.diff(offsets))
    keys = np.zeros((len(some), BANDS), np.uint64)
    if len(some):
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat((h ^ _FLIP[k]) * _ODD[k], offsets[some])
            keys[:, k // ROWS] = _spread(keys[:, k // ROWS] ^ least) + np.uint64(k)
    out = [np.zeros(0, np.int64)] * len(texts)
    for i, row in zip(some.tolist(), keys.view(np.int64), strict=True):
        out[i] = row
    return out


def with_bands(docs: DataFrame, name: str, bands: str, shingle: int = SHINGLE) -> DataFrame:
    """docs with the hash of the evened text and its band keys."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType()), T.StructField(bands, T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch.column("text"))
        own = np.array([xxhash.xxh64_intdigest(b" ".join(x.lower().split()), 42) for x in texts], np.uint64).view(np.int64)
        keys = [row for a, b in steps([len(x) for x in texts], STEP_BYTES) for row in band_keys(texts[a:b], shingle)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return map_batches(docs, run, schema)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b, ...; written) whose shingles match; texts: (id, text)."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = texts.sparkSession.sparkContext.broadcast(Bloom(ends, "id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task are taken once
        for batch in batches:
            ids = batch.column(0).to_numpy()
            new = [i for i in np.flatnonzero(wanted.value.has(ids)).tolist() if ids[i] not in seen and not seen.add(ids[i])]
            held = text_bytes(batch.column(1).take(pa.array(new, pa.int64())))
            for a, b in steps([len(x) for x in held], STEP_BYTES):
                h, offsets = shingle_hashes(held[a:b], shingle)
                rows = [np.unique(h[x:y]).view(np.int64) for x, y in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[new[a:b]]), pa.array(rows, pa.list_(pa.int64()))], names=["id", "words"])

    found = texts.select("id", "text").mapInArrow(sets, "id long, words array<long>")
    one = found.join(ends, "id", "left_semi").dropDuplicates(["id"])
    both = pairs.join(one.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(one.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select(*pairs.columns)


def link_texts(classes: DataFrame, texts: DataFrame, work: Workspace, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(id, comp) of the texts that share a bucket; classes: distinct (id, bands), written.

    Texts that share a ``print``, if there is one, meet its leaders, too, but not each other.
    """
    rows = classes.select("id", F.explode("bands").alias("key"), F.lit(True).alias("band"))
    if "print" in classes.columns:
        rows = rows.unionByName(classes.where("print is not null").select("id", F.col("print").alias("key"), F.lit(False).alias("band")))
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    # Exploded rows are more than Spark sizes them at: never broadcast.
    shared = work.write(rows.hint("merge").join(many, "key"), "buckets", "lz4")
    labels = work.write(shared.select("id").distinct().withColumn("comp", F.col("id")), "labels-0", "lz4")
    for k in range(1, ROUNDS + 2):
        held = shared.join(labels, "id")
        if k <= ROUNDS:
            lead = held.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("h"), "id", "comp")).alias("lead")).select("key", F.col("lead.id").alias("id_b"), F.col("lead.comp").alias("comp_b"))
            pairs = held.join(lead, "key").where("comp <> comp_b")
        else:
            held = held.where("band").drop("band")
            mixed = held.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
            held = work.write(held.join(mixed, "key"), "mixed", "lz4")
            pairs = held.join(held.select(F.col("id").alias("id_b"), F.col("comp").alias("comp_b"), "key"), "key").where("comp < comp_b")
        ordered = F.col("id") < F.col("id_b")
        own, other = F.col("comp"), F.col("comp_b")
        comps = F.when(ordered, own).otherwise(other).alias("comp_a"), F.when(ordered, other).otherwise(own).alias("comp_b")
        pairs = pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"), *comps)
        pairs = work.write(pairs.distinct(), f"pairs-{k}", "lz4")
        close = verified(pairs, texts, similarity, shingle)
        merged = components(close.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), work, f"round-{k}")
        moved = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        labels = work.write(moved, f"labels-{k}", "lz4")
        work.drop(f"pairs-{k}", f"labels-{k - 1}")
    work.drop("buckets", "mixed")
    return labels


def with_prints(classes: DataFrame, work: Workspace, radius: int) -> DataFrame:
    """classes (id, own, bands, fp) with ``print``, the key of the component of linked SimHash fingerprints; null for a text without a word."""
    points = work.write(classes.where(F.size("bands") > 0).select("fp").distinct(), "prints", "lz4")
    linked = link_fingerprints(points, Workspace(classes.sparkSession, "near-copies-prints"), radius)
    key = F.when(F.size("bands") > 0, F.xxhash64(F.lit("print"), F.coalesce("comp", "fp")))
    return work.write(classes.join(linked, "fp", "left").select("id", "own", "bands", key.alias("print")), "printed", "lz4")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, work: Workspace | None = None, radius: int | None = None) -> DataFrame:
    """One document of each component: that of the smallest doc_id (of rows that repeat it, one), with all its columns.

    With a ``radius``, texts whose SimHash fingerprints are linked at so many bits are candidates, too.
    """
    work = work or Workspace(docs.sparkSession, "near-copies")
    own, bands, fp = free_names(docs, "_text", "_bands", "_fp")
    marked = with_bands(docs, own, bands, shingle)
    marked = work.write(marked if radius is None else with_fingerprint(marked, fp), "documents")
    prints = [] if radius is None else [F.first(fp).alias("fp")]
    classes = marked.groupBy(F.col(own).alias("id")).agg(F.min(F.col("doc_id").cast("long")).alias("own"), F.first(bands).alias("bands"), *prints)
    classes = work.write(classes, "classes", "lz4")
    if prints:
        classes = with_prints(classes, work, radius)
    marked = marked.drop(bands, fp)
    linked = link_texts(classes.drop("own"), marked.select(F.col(own).alias("id"), "text"), work, similarity, shingle)
    held = classes.join(linked, "id", "left").select("id", "own", F.coalesce("comp", "id").alias("comp"))
    least = classes.join(linked, "id").groupBy("comp").agg(F.min("own").alias("least"))
    comp = held.join(least, "comp", "left").select(F.col("id").alias("fp"), "comp", F.coalesce("least", "own").alias("least"))
    return first_of(marked, own, comp).select(*docs.columns)
