"""Page versions and line differences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import let

KEPT_VERSIONS = 10


def newest(history: DataFrame, n: int = KEPT_VERSIONS) -> DataFrame:
    """The newest n versions of each url, by time then id.  A version is known by its url and id.

    Only keys are ranked (a url's ranks are limited before they are shuffled, too); bodies
    meet them by url and id, so those of one url are in many tasks.
    """
    order = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("id"))
    ranked = history.select("url", "id", "fetched_at").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return _beside(history, ranked.select(F.col("url").alias("_url"), F.col("id").alias("_id"), "rank"), "inner")


def _beside(history: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Versions with the other columns of keys (_url, _id, ...)."""
    return history.join(keys, history["url"].eqNullSafe(keys["_url"]) & history["id"].eqNullSafe(keys["_id"]), how).drop("_url", "_id")


def split_lines(x: str) -> list[str]:
    """As corvane.functions.text.lines."""
    parts = x.replace("\r\n", "\n").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


_LINES = T.ArrayType(T.StringType())
_COMPARED = T.StructType([T.StructField(*x) for x in (("added_lines", T.LongType()), ("removed_lines", T.LongType()), ("unchanged_lines", T.LongType()), ("added", _LINES), ("removed", _LINES), ("most", T.LongType()))])


@F.pandas_udf(_COMPARED)
def _compared(new: pd.Series, old: pd.Series) -> pd.DataFrame:
    """Lines of each side that the other side lacks; by sets, which no built-in function over arrays does with repeats kept."""
    rows = []
    for a, b in zip(new, old, strict=True):
        if a is None or b is None:
            rows.append((0, 0, 0, [], [], 0))
            continue
        x, y = split_lines(a), split_lines(b)
        in_x, in_y = set(x), set(y)
        added, removed = [v for v in x if v not in in_y], [v for v in y if v not in in_x]
        rows.append((len(added), len(removed), len(x) - len(added), added, removed, max(len(x), len(y))))
    return pd.DataFrame(rows, columns=["added_lines", "removed_lines", "unchanged_lines", "added", "removed", "most"])


def diff(new: Column, old: Column) -> Column:
    """Line difference by membership; a null old body is a first snapshot without differences."""

    def shown(c: Column) -> Column:
        similarity = F.when(c["most"] == 0, 100.0).otherwise(F.round(c["unchanged_lines"] / c["most"] * 100, 2))
        marked = lambda each, mark: F.array_join(F.transform(each, lambda x: F.concat(F.lit(mark), x, F.lit("\n"))), "")
        return F.struct(
            c["added_lines"].alias("added_lines"),
            c["removed_lines"].alias("removed_lines"),
            c["unchanged_lines"].alias("unchanged_lines"),
            similarity.alias("similarity_percent"),
            F.concat(marked(c["added"], "+ "), marked(c["removed"], "- ")).alias("diff_text"),
        )

    return let(_compared(new, old), shown)


def diffs(history: DataFrame) -> DataFrame:
    """Each version against the one before it: url, id, old_hash, new_hash and the difference.  A version is known by its url and id.

    Pairs are found on keys and hashes alone; bodies come to them by url and id, so
    those of one url are in many tasks and none is in a window.
    """
    order = Window.partitionBy("url").orderBy("fetched_at", "id")
    keys = history.select("url", "id", "fetched_at", "content_hash").distinct()
    pairs = keys.select("url", F.col("id").alias("_id"), F.lag("id").over(order).alias("_before"), F.lag("content_hash").over(order).alias("old_hash"), F.lag(F.lit(True)).over(order).alias("_any"))
    new = _beside(history.select("url", "id", F.col("content_hash").alias("new_hash"), F.col("content_body").alias("_new")), pairs.withColumnRenamed("url", "_url"), "inner")
    old = history.select(F.col("url").alias("_url"), F.col("id").alias("_old_id"), F.col("content_body").alias("_old")).dropDuplicates(["_url", "_old_id"])
    both = new.join(old, new["_any"] & new["url"].eqNullSafe(old["_url"]) & new["_before"].eqNullSafe(old["_old_id"]), "left")
    return both.select("url", "id", "old_hash", "new_hash", diff(F.col("_new"), F.col("_old")).alias("d")).select("url", "id", "old_hash", "new_hash", "d.*")
