"""Search results: choice of backend and reports (H3, H4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.tokens import preview

FETCHED, PREVIEW_BYTES, MOST, DEFAULT = 3, 2000, 10, 5


def prefer(first: DataFrame, second: DataFrame, key: str = "query") -> DataFrame:
    """All results of the first backend where it has any for a query, else the second's."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def report(results: DataFrame, key: str = "query", with_content: bool = False, most: int = DEFAULT) -> DataFrame:
    """key and a numbered list of its results (pos from 0, title, url, and content where asked); of the first three with their content's beginning."""
    most = min(most, MOST)
    kept = results.where(F.col("pos") < most)
    number = (F.col("pos") + 1).cast("string")
    line = F.concat(number, F.lit(". "), F.col("title"), F.lit(" — "), F.col("url"), F.lit("\n"))
    if with_content:
        full = F.concat(F.lit("## "), number, F.lit(". "), F.col("title"), F.lit("\n"), F.col("url"), F.lit("\n\n"), F.coalesce(preview(F.col("content"), PREVIEW_BYTES), F.lit("")), F.lit("\n\n"))
        line = F.when(F.col("pos") < FETCHED, full).otherwise(line)
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "").alias("report"))
