"""Structured Streaming forms of the operators that keep running state.

These are extensions: the batch operators define the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators import history
from corvane.operators.boilerplate import MAX_BLOCK_BYTES

_STATE = "avg bigint, n bigint, ok bigint, last_success timestamp_ntz, last_check timestamp_ntz"
_STATS = "domain string, strategy string, avg_latency_ms bigint, success_rate double, total_requests int, last_success_at timestamp_ntz, last_check_at timestamp_ntz"


def route_stats(log: DataFrame) -> DataFrame:
    """Route statistics as a stateful operator (update mode).

    Outcomes of one micro-batch are merged in order of (ts, event_id); one that
    arrives in a later batch is merged after all earlier batches, so the floored
    mean, which depends on order, may then differ from the batch result.
    """

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        avg, n, ok, last, check = state.get if state.exists else (0, 0, 0, None, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for latency in rows["latency_ms"].tolist():
            avg, n = (avg * n + latency) // (n + 1), n + 1
        good = rows.loc[rows["success"], "ts"]
        ok += len(good)
        if len(good):
            last = good.max().to_pydatetime() if last is None else max(last, good.max().to_pydatetime())
        newest = rows["ts"].max().to_pydatetime()
        check = newest if check is None else max(check, newest)
        state.update((int(avg), int(n), int(ok), last, check))
        yield pd.DataFrame({"domain": [key[0]], "strategy": [key[1]], "avg_latency_ms": [int(avg)], "success_rate": [ok / n], "total_requests": [int(n)], "last_success_at": [last], "last_check_at": [check]})

    return log.select("domain", "strategy", "event_id", "ts", "latency_ms", "success").groupBy("domain", "strategy").applyInPandasWithState(merge, _STATS, _STATE, "update", GroupStateTimeout.NoTimeout)


def block_counts(lines: DataFrame) -> DataFrame:
    """Occurrences of trimmed lines by domain (update or complete mode); lines: domain, line."""
    block = F.trim(F.col("line"))
    return lines.where((block != "") & (F.octet_length(block) <= MAX_BLOCK_BYTES)).groupBy("domain", F.sha2(block, 256).alias("block_hash")).agg(F.count(F.lit(1)).alias("n"))


def sessions(log: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Fetch sessions by domain: ended by a gap, late rows within the watermark still count."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "domain").agg(F.count(F.lit(1)).alias("n")).select("domain", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")


#: Parts of the store of newest versions, by url.
STORE_BUCKETS = 256


def store_diffs(versions: DataFrame, current_path: str, diffs_path: str):
    """A foreachBatch writer: each batch's versions are compared with the newest ones stored before.

    A batch adds its own newest versions under batch=n and bucket=k and rewrites nothing;
    it reads the buckets of its urls alone.  A repeated batch gives the same files.
    """
    bucket = F.pmod(F.xxhash64("url"), F.lit(STORE_BUCKETS)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        # At most STORE_BUCKETS rows.
        touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]
        known = batch.limit(0)
        if number and touched:
            stored = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])).parquet(current_path)
            earlier = stored.where((F.col("batch") < number) & F.col("bucket").isin(touched)).select(*batch.columns)
            known = history.newest(earlier.join(batch.select("url").distinct(), "url", "left_semi").select(*batch.columns), 1).drop("rank")
        found = history.diffs(known.unionByName(batch)).join(batch.select("url", "id"), ["url", "id"], "left_semi")
        found.write.mode("overwrite").parquet(f"{diffs_path}/batch={number}")
        history.newest(batch, 1).drop("rank").withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{current_path}/batch={number}")
        batch.unpersist()

    return versions.writeStream.foreachBatch(apply)
