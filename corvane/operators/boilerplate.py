"""Boilerplate by fingerprints of blocks (B1-B5).  A block is a trimmed line that isn't blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import bytes_of, let, lines, trim_space

MAX_BLOCK_BYTES = 2000
LEAST_COUNT = 3
#: Parts that the rows of a line are dealt out to when boilerplate is looked up.
SALTS = 32


def exploded(docs: DataFrame, domain: str, key: str, text: str, *more: str) -> DataFrame:
    """domain, key, pos, line, block_hash (null where a line can't be a block), and more columns."""
    rows = docs.select(domain, key, *more, F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("block", trim_space(F.col("line")))
    counts = (F.col("block") != "") & (bytes_of(F.col("block")) <= MAX_BLOCK_BYTES)
    return rows.withColumn("block_hash", F.when(counts, F.sha2("block", 256))).drop("block")


def block_counts(rows: DataFrame, domain: str) -> DataFrame:
    """Occurrences of each block in a domain; several on one page all count."""
    return rows.where("block_hash is not null").groupBy(domain, "block_hash").agg(F.count(F.lit(1)).alias("n"))


def boilerplate(counts: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    return counts.where(F.col("n") >= least)


def strip(docs: DataFrame, blocks: DataFrame, domain: str, key: str, text: str) -> DataFrame:
    """domain, key, text without boilerplate lines; blank lines stay, a text of nothing else is empty; a text without lines has no row.

    Only places and hashes of lines that can be blocks are shuffled to find the
    ones to drop, those of one line to SALTS places, as a line may be on every page; the
    texts move once, to meet their documents' lists.
    """
    marks = blocks.select(domain, "block_hash", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    hashed = docs.where(F.col(text) != "").select(domain, key, F.xxhash64(text).alias("_text"), text)
    rows = exploded(hashed, domain, key, text, "_text").where("block_hash is not null").select(domain, key, "_text", "pos", "block_hash")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(key, "_text"), F.lit(SALTS)))
    gone = rows.join(marks, [domain, "block_hash", "_salt"], "left_semi").groupBy(domain, key, "_text").agg(F.collect_set("pos").alias("_gone"))
    right = gone.select(F.col(domain).alias("_domain"), F.col(key).alias("_key"), F.col("_text").alias("_hash"), "_gone")
    same = hashed[domain].eqNullSafe(F.col("_domain")) & hashed[key].eqNullSafe(F.col("_key")) & (hashed["_text"] == F.col("_hash"))

    def without(all_lines: Column) -> Column:
        # The difference of sets of places is linear, unlike a search for each place.
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_gone"))
        return F.array_join(F.transform(F.array_sort(kept), lambda i: F.get(all_lines, i)), "\n")

    left = let(lines(F.col(text)), without)
    every = F.array_join(lines(F.col(text)), "\n")
    return hashed.join(right, same, "left").select(domain, key, F.when(F.col("_gone").isNull(), every).otherwise(left).alias("text"))


def domain_counts(counts: DataFrame, domain: str) -> DataFrame:
    return counts.groupBy(domain).agg(F.count(F.lit(1)).alias("blocks"))


def clear_domain(counts: DataFrame, domain: str, value: str) -> DataFrame:
    return counts.where(F.col(domain) != value)
