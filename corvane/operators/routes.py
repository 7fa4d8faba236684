"""Route statistics, decisions and fallbacks over fetch logs.

fetch_log: event_id, ts, domain, strategy, latency_ms, success (and url, status, headers where known).
route_stats: domain, strategy, avg_latency_ms, success_rate, total_requests, last_success_at, last_check_at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import ship

CAPACITY = 10_000
#: Strategies in the order of falling back, and those that are probed.
STRATEGIES = ("HttpSimple", "TlsChrome", "TlsMobile", "Headless", "PublicApi", "YouTube")
PROBED = ("HttpSimple", "TlsChrome", "TlsMobile", "Headless")
DEFAULT_STRATEGY, PROBE_FAILED_MS, MAX_ATTEMPTS = "HttpSimple", 5000, 3
KEY = ["domain", "strategy"]


def fallback_rank(strategy: Column) -> Column:
    """Place in the fallback order from 0; null for other names."""
    return F.nullif(F.array_position(F.array(*map(F.lit, STRATEGIES)), strategy), F.lit(0)) - 1


#: Latencies in a block that goes from the sort to the fold.
BLOCK = 1 << 14


def ordered_means(log: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """domain, strategy, avg_latency_ms: the running mean that is floored at each step, in order of (ts, event_id).

    The value depends on the order, so it can't be split into partial sums; nor is a route
    ever held as a whole.  The log is sorted across partitions, each sorted partition
    passes on its routes' latencies in blocks of bounded size, and each route's state
    (mean, count) is carried through its blocks in order.  ``start`` has the state of
    known routes (KEY, avg_latency_ms, total_requests).  A null latency makes the mean null.
    """
    ship(log.sparkSession)
    names = [*KEY, "part", "nth", "mean", "n", "values"]
    schema = "domain string, strategy string, part int, nth long, mean long, n long, values array<bigint>"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in KEY)))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            cuts = [a + k for a, b in zip(cuts, [*cuts[1:], len(keys)]) for k in range(0, b - a, BLOCK)]
            if cuts:
                held, size = batch.column("latency_ms").cast(pa.int64()).to_pylist(), len(cuts)
                columns = [*([keys[i][k] for i in cuts] for k in range(2)), [part] * size, list(range(nth, nth + size)), [None] * size, [None] * size, [held[a:b] for a, b in zip(cuts, [*cuts[1:], len(keys)])]]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                nth += size
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=[*KEY, "avg_latency_ms"])

        key, mean, n = None, 0, 0
        for batch in batches:
            done = []
            for domain, strategy, mean0, n0, values in zip(*(batch.column(c).to_pylist() for c in (*KEY, "mean", "n", "values"))):
                if (domain, strategy) != key:
                    if key is not None:
                        done.append((*key, mean))
                    key, mean, n = (domain, strategy), 0, 0
                if n0 is not None:
                    mean, n = mean0, n0
                for x in values:
                    # The quotient goes towards zero, as of whole numbers.
                    if mean is not None:
                        whole = None if x is None else mean * n + x
                        mean = None if whole is None else whole // (n + 1) if whole >= 0 else -(-whole // (n + 1))
                    n += 1
            if done:
                yield out(done)
        if key is not None:
            yield out([(*key, mean)])

    parts = log.select(*KEY, "ts", "event_id", "latency_ms").orderBy(*KEY, "ts", "event_id", "latency_ms").select(*KEY, "latency_ms").mapInArrow(blocks, schema)
    if start is not None:
        known = start.select(*KEY, F.lit(-1).alias("part"), F.lit(0).cast("long").alias("nth"), F.col("avg_latency_ms").cast("long").alias("mean"), F.col("total_requests").cast("long").alias("n"), F.array().cast("array<bigint>").alias("values"))
        parts = known.unionByName(parts)
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "part", "nth").mapInArrow(fold, "domain string, strategy string, avg_latency_ms long")


def _by_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join on KEY where nulls are equal; the left side's keys stay, the right side's are where they are missing."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in KEY})
    on = [left[k].eqNullSafe(other[f"_{k}"]) for k in KEY]
    return left.join(other, on, how)


def route_stats(log: DataFrame) -> DataFrame:
    """Statistics as if each outcome had been merged in order of (ts, event_id); all but the mean aggregates partially."""
    sums = log.groupBy(*KEY).agg(
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.count(F.lit(1)).cast("int").alias("total_requests"),
        F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success_at"),
        F.max("ts").alias("last_check_at"),
    )
    return _by_key(sums, ordered_means(log), "left").select(*KEY, "avg_latency_ms", "success_rate", "total_requests", "last_success_at", "last_check_at")


def route_stats_mean(log: DataFrame) -> DataFrame:
    """As route_stats with a plain floored mean: partial aggregation only, for logs where a route is too large to fold."""
    return log.groupBy(*KEY).agg(
        F.floor(F.avg("latency_ms")).alias("avg_latency_ms"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.count(F.lit(1)).cast("int").alias("total_requests"),
        F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success_at"),
        F.max("ts").alias("last_check_at"),
    )


def merge_outcomes(stats: DataFrame, log: DataFrame) -> DataFrame:
    """Known statistics carried on with new outcomes."""
    new = log.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("success").cast("long")).alias("_ok"),
        F.max(F.when(F.col("success"), F.col("ts"))).alias("_last"),
        F.max("ts").alias("_check"),
    )
    old_n, new_n = F.coalesce("total_requests", F.lit(0)), F.coalesce("_n", F.lit(0))
    merged = _by_key(stats, new, "full").select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in KEY],
        ((F.coalesce("success_rate", F.lit(0.0)) * old_n + F.coalesce("_ok", F.lit(0))) / (old_n + new_n)).alias("success_rate"),
        (old_n + new_n).cast("int").alias("total_requests"),
        F.greatest("last_success_at", "_last").alias("last_success_at"),
        F.greatest("last_check_at", "_check").alias("last_check_at"),
    )
    return _by_key(merged, ordered_means(log, stats), "left").select(*KEY, "avg_latency_ms", "success_rate", "total_requests", "last_success_at", "last_check_at")


def recordable(log: DataFrame) -> DataFrame:
    """Outcomes that count: a script page fetched without a browser doesn't; success is a status below 400."""
    return log.where(~(F.col("is_spa") & (F.col("strategy") != "Headless"))).withColumn("success", F.col("status") < 400)


def score(rate: Column, latency_ms: Column) -> Column:
    return rate * (1 / F.greatest(latency_ms / 1000.0, F.lit(0.001)))


def with_score(stats: DataFrame) -> DataFrame:
    return stats.withColumn("score", score(F.col("success_rate"), F.col("avg_latency_ms")))


def ranked(stats: DataFrame) -> DataFrame:
    """Strategies of each domain by score; equal scores by name."""
    return with_score(stats).withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "strategy")))


def best(stats: DataFrame) -> DataFrame:
    """domain, strategy and score of the best route, equal scores by name: an aggregate, so it combines before the shuffle."""
    place = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("score"), "strategy")
    return with_score(stats).groupBy("domain").agg(F.min_by(F.struct("strategy", "score"), place).alias("b")).select("domain", "b.strategy", "b.score")


def evict_stale(stats: DataFrame, min_requests: int, min_rate: float, days: int, now: Column) -> DataFrame:
    """Routes that stay: not those often tried, mostly failing and unchecked for so many days."""
    stale = (F.col("total_requests") >= min_requests) & (F.col("success_rate") < min_rate) & (F.col("last_check_at") < now - F.make_dt_interval(F.lit(days)))
    return stats.where(~F.coalesce(stale, F.lit(False)))


def evict_over_capacity(stats: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The most recently checked routes, a top-k."""
    return stats.orderBy(F.desc("last_check_at"), *KEY).limit(capacity)


def resolve(urls: DataFrame, stats: DataFrame, default: str = DEFAULT_STRATEGY) -> DataFrame:
    """urls (with domain) and whether a route is known, its strategy and score."""
    known = best(stats).select("domain", F.col("strategy").alias("_s"), F.col("score").alias("_v"))
    return urls.join(known, "domain", "left").select(*[urls[c] for c in urls.columns], F.col("_s").isNotNull().alias("known"), F.coalesce("_s", F.lit(default)).alias("strategy"), F.col("_v").alias("score"))


def resolve_with_probes(urls: DataFrame, stats: DataFrame, winners: DataFrame, default: str = DEFAULT_STRATEGY) -> DataFrame:
    """An explicit strategy (score 1), else the known route, else the probe's winner (score 0.5), else the default."""
    known = best(stats).select("domain", F.col("strategy").alias("_s"), F.col("score").alias("_v"))
    probed = winners.select("domain", F.col("strategy").alias("_p"))
    rows = urls.join(known, "domain", "left").join(probed, "domain", "left")
    explicit = F.col("explicit")
    found = F.when(explicit.isNotNull(), 1.0).when(F.col("_s").isNotNull(), F.col("_v")).when(F.col("_p").isNotNull(), 0.5)
    return rows.select(*[urls[c] for c in urls.columns], found.isNotNull().alias("known"), F.coalesce(explicit, "_s", "_p", F.lit(default)).alias("strategy"), found.alias("score"))


def probe_winner(probes: DataFrame, default: str = DEFAULT_STRATEGY) -> DataFrame:
    """domain, strategy, latency_ms, success: the fastest probe that wasn't blocked, ties by order; else the default as a failure."""
    usable = F.col("strategy").isin(*PROBED) & F.col("status").isNotNull() & ~F.col("status").isin(403, 503)
    place = F.when(usable, F.struct("latency_ms", fallback_rank(F.col("strategy")).alias("rank"), "strategy"))
    found = probes.groupBy("domain").agg(F.min(place).alias("w"))
    return found.select("domain", F.coalesce("w.strategy", F.lit(default)).alias("strategy"), F.coalesce("w.latency_ms", F.lit(PROBE_FAILED_MS)).cast("long").alias("latency_ms"), F.col("w").isNotNull().alias("success"))


def next_strategy(current: Column, visited: Column, error_class: Column, attempts: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """The next later strategy that wasn't tried, or null after the last attempt or a missing page."""
    order = F.array(*map(F.lit, STRATEGIES))
    left = F.filter(order, lambda x, i: (i > fallback_rank(current)) & ~F.array_contains(visited, x))
    return F.when((attempts >= max_attempts) | (error_class == "NotFound"), F.lit(None).cast("string")).otherwise(F.get(left, F.lit(0)))


def replay(requests: DataFrame, outcomes: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Replays the fallback loop: url, strategy (first) -> final, attempts, done reason.

    outcomes: url, strategy, error_class (null if fetched), is_spa, valuable.  Each
    attempt is one equi-join on (url, strategy), merged: Spark sizes exploded outcomes by
    the table before them, and would broadcast all of them.  The loop is unrolled.
    """
    known = outcomes.select(F.col("url").alias("_url"), F.col("strategy").alias("_strategy"), "error_class", "is_spa", "valuable").hint("merge")
    rows = requests.select("url", F.col("strategy").alias("current"), F.array().cast("array<string>").alias("visited"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("result"))
    for k in range(1, max_attempts + 1):
        joined = rows.join(known, (rows["url"] == known["_url"]) & (rows["current"] == known["_strategy"]) & rows["result"].isNull(), "left")
        going = F.col("result").isNull()
        visited = F.when(going, F.array_append("visited", F.col("current"))).otherwise(F.col("visited"))
        error = F.when(F.col("_url").isNull(), F.lit("Transient")).otherwise(F.col("error_class"))
        following = F.when(error.isNotNull(), F.when(error == "RateLimited", F.lit(None).cast("string")).otherwise(next_strategy(F.col("current"), visited, error, F.lit(k), max_attempts))).when(
            F.col("is_spa") & ~F.array_contains(visited, "Headless"), F.lit("Headless")
        ).otherwise(next_strategy(F.col("current"), visited, F.lit("Transient"), F.lit(k), max_attempts))
        good = error.isNull() & F.col("valuable")
        stopped = F.when(error.isin("NotFound", "RateLimited"), F.concat(F.lit("error:"), error)).when(error.isNull(), "low-quality").otherwise("exhausted")
        result = F.when(~going, F.col("result")).when(good, "ok").when(following.isNull(), stopped)
        step = joined.select("url", "current", visited.alias("visited"), F.when(going, k).otherwise(F.col("attempts")).alias("attempts"), result.alias("result"), following.alias("_next"))
        rows = step.select("url", F.when(F.col("result").isNull(), F.col("_next")).otherwise(F.col("current")).alias("current"), "visited", "attempts", "result")
    # After the last attempt a script page may have a strategy that wasn't tried any more.
    return rows.select("url", F.element_at("visited", -1).alias("strategy"), "attempts", F.coalesce("result", F.lit("exhausted")).alias("result"), F.array_join("visited", ",").alias("visited"))


def remove(stats: DataFrame, domain: str, strategy: str | None = None) -> DataFrame:
    gone = F.col("domain") == domain
    return stats.where(~(gone & (F.col("strategy") == strategy) if strategy else gone))
