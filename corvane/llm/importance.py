"""Importance resampling towards a target distribution, scored without exploding a document.

A document's features are all runs of 1 to ``max_words`` consecutive words, each known
by a bucket.  Higher-order functions make a document's array of buckets and fold it over
a literal array of gains, so scoring is a narrow stage; what is shuffled before is the
count of each bucket alone, at most ``buckets`` rows a task.  A gain is the floored
thousandfold log ratio of a bucket's smoothed shares in the target and in the documents;
a document's weight is the floored mean of its gains, and Gumbel noise drawn from its id
makes the highest scores a sample without replacement.

The draw: scores are integers within some tens of thousands of values (a log ratio of
counts plus noise), so counts by score give the lowest drawn score; the rows from there
on are sorted across partitions by (score, id, row), and a rank is a partition's offset
plus the place in it.  No task sees more than its range of the sort.

Defined cases: null and empty texts have no features, weight 0, and no part in the draw
unless ``min_words`` is 0; a null id draws its noise from the empty id and comes last
among equal scores; repeated rows are documents of their own (equal ids have equal noise
and follow each other); a very long text is one array of ints; without target texts, or
without documents, the gains are those of the smoothing alone; an empty table gives no
rows; other columns are ignored by ``importance_scores`` and kept by ``resample``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import let
from corvane.llm.common import Workspace, free_names

BUCKETS, MAX_WORDS, SEED, SHARE, MIN_WORDS = 10_000, 1, 2024, 10, 20
#: Fixed value: the ASCII characters that no word has.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of a text's words, A-Z lower-cased; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def feature_buckets(given: Column, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> Column:
    """Array of the buckets of all features of an array of words."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(w: Column, n: int) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: bucket(F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])))

    if max_words == 1:
        return F.transform(given, bucket)
    return let(given, lambda w: F.concat(*[runs(w, n) for n in range(1, max_words + 1)]))


def bucket_table(texts: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id (null without one), n_words and b, the array of buckets, of every row."""
    doc_id = F.col("doc_id") if "doc_id" in texts.columns else F.lit(None).cast("long").alias("doc_id")
    split = texts.select(doc_id, words(F.col("text")).alias("w"))
    return split.select("doc_id", F.size("w").cast("long").alias("n_words"), feature_buckets(F.col("w"), buckets, max_words).alias("b"))


def bucket_counts(table: DataFrame) -> DataFrame:
    """bucket, n: counts over all rows of a bucket table, combined before the shuffle."""
    return table.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gain_array(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, of two bucket tables; ``buckets`` rows are all that comes to the driver."""
    s = bucket_counts(docs).select("bucket", F.col("n").alias("s"))
    t = bucket_counts(target).select("bucket", F.col("n").alias("t"))
    sums = s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).toArrow()
    found = {b: (x, y) for b, x, y in zip(*(sums.column(c).to_pylist() for c in ("bucket", "s", "t")))}
    of_docs, of_target = (float(sum(x[k] for x in found.values()) + buckets) for k in (0, 1))
    counts = (found.get(b, (0, 0)) for b in range(buckets))
    return [math.floor(1000 * math.log((t + 1) * of_docs / ((s + 1) * of_target))) for s, t in counts]


def weight(found: Column, gains: list[int]) -> Column:
    """Floored mean of the gains of an array of buckets; 0 for none."""
    table = F.expr(f"cast(split('{','.join(map(str, gains))}', ',') as array<bigint>)")  # a constant to the optimizer
    total = F.aggregate(found, F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    n = F.size(found).cast("long")
    return F.when(n > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(F.lit(0).cast("long"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandfold Gumbel noise of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def importance_scores(docs: DataFrame, target: DataFrame, work: Workspace, buckets: int = BUCKETS, max_words: int = MAX_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every row of docs (doc_id, text); target: text.

    Texts are read once: their arrays of buckets are a work table, about half as large as the texts.
    """
    table = work.write(bucket_table(docs, buckets, max_words), "buckets")
    gains = gain_array(table, bucket_table(target, buckets, max_words), buckets)
    out = table.select("doc_id", F.size("b").cast("long").alias("n_features"), "n_words", weight(F.col("b"), gains).alias("weight"))
    return out.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def draw(scores: DataFrame, work: Workspace, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """scores with rank: 1, 2, ... for ``share`` of a hundred of those with enough words, highest score first; null for others."""
    row, at, part, offset = free_names(scores, "row", "at", "part", "offset")
    kept = work.write(scores.withColumn(row, F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= min_words
    held = kept.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = sorted(zip(held.column("score").to_pylist(), held.column("n").to_pylist()), reverse=True)
    wanted, seen, cut = share * sum(n for _, n in counts) // 100, 0, None
    for score, n in counts:
        if seen < wanted:
            seen, cut = seen + n, score
    inside = able & (F.col("score") >= cut) if cut is not None else F.lit(False)
    null = F.lit(None).cast("long").alias("rank")
    others = kept.where(~F.coalesce(inside, F.lit(False))).select(*scores.columns, null)
    if cut is None:
        return others
    ordered = kept.where(inside).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), row).withColumn(at, F.monotonically_increasing_id())
    placed = work.write(ordered.drop(row).select("*", F.shiftright(at, 33).alias(part)), "placed")
    sizes, offsets, before = placed.groupBy(part).count().toArrow(), [], 0  # one row a partition
    for p, n in sorted(zip(sizes.column(part).to_pylist(), sizes.column("count").to_pylist())):
        offsets.append((p, before))
        before += n
    starts = F.broadcast(scores.sparkSession.createDataFrame(offsets, f"{part} long, {offset} long"))
    rank = F.col(offset) + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return others.unionByName(placed.join(starts, part).select(*scores.columns, F.when(rank <= wanted, rank).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, work: Workspace, share: int = SHARE, min_words: int = MIN_WORDS, **how) -> DataFrame:
    """The rows of docs, with all of their columns, whose id is drawn."""
    drawn = draw(importance_scores(docs, target, work, **how), work, share, min_words).where("rank is not null").select("doc_id").distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["doc_id"]), "left_semi")
