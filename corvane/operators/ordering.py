"""Ranges of equal numbers of rows in an order, without a global sort.

Split points are a sample of the keys by their hash, so they are the same whenever the
rows are; of equal keys all fall into one range.  Only the points come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Split points that are expected of a sample, and rows that need none.
RANGES, FEW_ROWS = 64, 1 << 16


def split_points(rows: DataFrame, key: str, ranges: int = RANGES, few: int = FEW_ROWS) -> list[Column]:
    """About so many keys (structs) of the rows as constants in ascending order; none if there are few rows.  Reads the keys once or twice."""
    n = rows.count()
    if n <= few:
        return []
    # A sample of one in n / ranges of the distinct keys.
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(max(1, n // ranges))) == 0).select(key).distinct().orderBy(key)
    return [constant(r[0], rows, key) for r in sample.collect()]


def constant(value: Row, rows: DataFrame, key: str) -> Column:
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(value, rows.schema[key].dataType.fields, strict=True)))


def range_of(key: Column, splits: list[Column], at: int = 0) -> Column:
    """Number of split points up to the key, by halving."""
    if not splits:
        return F.lit(at)
    mid = len(splits) // 2
    return F.when(key < splits[mid], range_of(key, splits[:mid], at)).otherwise(range_of(key, splits[mid + 1 :], at + mid + 1))
