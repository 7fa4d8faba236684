"""Content cache: upserts, reads, evictions and reports.

url_cache: url, strategy, extraction_mode, content_hash, content, content_type,
original_size, created_at, last_accessed_at, expires_at, etag, last_modified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import urls
from corvane.functions.classify import quality_reason
from corvane.functions.text import bytes_of
from corvane.operators.ordering import FEW_ROWS, RANGES, constant, range_of, split_points

MAX_ENTRY_BYTES = 102_400
SEARCH_DEFAULT, SEARCH_MOST = 20, 100
KEY = ["url", "strategy", "extraction_mode"]


def put(cache: DataFrame, entries: DataFrame, ttl_seconds: int, strict_parity: bool = False) -> DataFrame:
    """The cache after new entries (with created_at): the latest of a key wins, too large ones are skipped.

    strict_parity leaves the mode out of the key.
    """
    key = KEY[:2] if strict_parity else KEY
    fits = entries.where(bytes_of(F.col("content")) <= MAX_ENTRY_BYTES)
    made = fits.withColumns({"content_hash": F.sha2("content", 256), "original_size": bytes_of(F.col("content")), "last_accessed_at": F.col("created_at"), "expires_at": F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))})
    both = cache.withColumn("_new", F.lit(0)).unionByName(made.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    # max_by is no window: a key's rows are combined before the shuffle.
    columns = [c for c in both.columns if c != "_new" and c not in key]
    latest = both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct("created_at", "_new", "content_hash")).alias("_e"))
    return latest.select(*key, "_e.*").select(*cache.columns)


def get(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Entries of the keys (url, strategy) that haven't expired, with their age in seconds."""
    return cache.join(keys, keys.columns).where(F.col("expires_at") > now).withColumn("age_seconds", F.unix_timestamp(now) - F.unix_timestamp("created_at"))


def touch(cache: DataFrame, reads: DataFrame) -> DataFrame:
    """last_accessed_at raised to the latest read of each key (reads: url, strategy, access_ts)."""
    last = reads.groupBy("url", "strategy").agg(F.max("access_ts").alias("_ts"))
    return cache.join(last, ["url", "strategy"], "left").withColumn("last_accessed_at", F.greatest("last_accessed_at", "_ts")).select(*cache.columns)


def get_any(cache: DataFrame, now: Column) -> DataFrame:
    """The newest entry of each url; if that one has expired the url has none."""
    columns = [c for c in cache.columns if c != "url"]
    newest = cache.groupBy("url").agg(F.max_by(F.struct(*columns), F.struct("created_at", "strategy")).alias("e")).select("url", "e.*")
    return newest.where(F.col("expires_at") > now)


def drop_expired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def validated(cache: DataFrame) -> DataFrame:
    """Entries whose content passes the quality gate."""
    return cache.where(quality_reason(F.col("content")).isNull())


def delete(cache: DataFrame, url: str | None = None, strategy: str | None = None, domain: str | None = None, strict: bool = True) -> DataFrame:
    """The cache without the entries of a url (and strategy), or of a domain, or of both."""
    if url is None and domain is None:
        raise ValueError("a url or a domain is needed")
    gone = F.lit(False)
    if url is not None:
        gone = gone | ((F.col("url") == url) & (F.col("strategy") == strategy if strategy else F.lit(True)))
    if domain is not None:
        gone = gone | in_domain(F.col("url"), domain, strict)
    return cache.where(~F.coalesce(gone, F.lit(False)))


def in_domain(url: Column, domain: str, strict: bool = True) -> Column:
    """Equal domains; not strict: a pattern on the url's beginning, as stores with LIKE have it."""
    if strict:
        return F.coalesce(urls.domain(url) == domain, F.lit(False))
    pattern = domain.replace("\\", "\\\\")
    return F.ilike(url, F.lit(f"http://{pattern}%")) | F.ilike(url, F.lit(f"https://{pattern}%"))


def clear_domain(cache: DataFrame, domain: str, strict: bool = True) -> DataFrame:
    return cache.where(~in_domain(F.col("url"), domain, strict))


def clear_older_than(cache: DataFrame, seconds: int, now: Column) -> DataFrame:
    return cache.where(~(F.col("created_at") < now - F.make_dt_interval(secs=F.lit(seconds))))


def clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def evict_lru(cache: DataFrame, max_bytes: int, buckets: int = RANGES, few: int = FEW_ROWS) -> DataFrame:
    """Entries that stay after the least recently read went until the rest fits.

    Entries are in order of last read, url, strategy and mode (nulls first); those of one key go or stay together.
    Only the first key that stays is looked for: sizes are summed by about ``buckets`` ranges of equal
    numbers of entries, whatever their times, then again within the range where the cut is, until it has
    ``few`` entries at most; these are summed key by key.  The entries themselves are filtered where they
    are read and don't move.  The sums run at once (as many turns as the logarithm of the entries' number).
    """
    key = F.struct(F.unix_micros(F.to_timestamp("last_accessed_at")).alias("t"), *KEY)
    rows = cache.select(key.alias("_k"), F.coalesce("original_size", F.lit(0)).alias("_n"))
    left = rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"] - max_bytes
    if left <= 0:
        return cache
    upper = None  # the first key behind the cut range
    while splits := split_points(rows, "_k", buckets, few):
        dealt = rows.withColumn("_r", range_of(F.col("_k"), splits))
        # At most one range for each split point and one more; one of them has the cut.
        sums = _running(dealt, "_r").collect()
        if len(sums) == 1:  # entries of one key
            break
        cut = next(x for x in sums if x["_before"] < left <= x["_before"] + x["_own"])
        r, left = cut["_r"], left - cut["_before"]
        upper = splits[r] if r < len(splits) else upper
        if r:
            rows = rows.where(F.col("_k") >= splits[r - 1])
        if r < len(splits):
            rows = rows.where(F.col("_k") < splits[r])
    first = _running(rows, "_k").where(F.col("_before") >= left).agg(F.min("_k").alias("k")).first()["k"]
    first = upper if first is None else constant(first, rows, "_k")
    return cache.limit(0) if first is None else cache.where(key >= first)


def _running(rows: DataFrame, by: str) -> DataFrame:
    """by, _own (bytes) and _before (bytes of all smaller ones)."""
    own = rows.groupBy(by).agg(F.sum("_n").alias("_own"))
    return own.withColumn("_before", F.sum("_own").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own"))


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.countDistinct("url").alias("entry_count"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("total_size_bytes"))


def detailed_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entry_count"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("total_size_bytes"), F.min("created_at").alias("oldest_at"), F.max("created_at").alias("newest_at"))


def top_domains(cache: DataFrame, most: int) -> DataFrame:
    """Domains with the most rows; ties by name."""
    counts = cache.groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n")).where("domain is not null")
    return counts.orderBy(F.desc("n"), "domain").limit(most)


def search(cache: DataFrame, text: str, limit: int = SEARCH_DEFAULT) -> DataFrame:
    """Entries whose url holds the text by any case, newest first."""
    pattern = text.replace("\\", "\\\\")
    return cache.where(F.ilike("url", F.lit(f"%{pattern}%"))).orderBy(F.desc("created_at"), "url", "strategy").limit(min(limit, SEARCH_MOST))


def unchanged(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """fetched (url, strategy, content) with the old hash and whether it is the same."""
    old = cache.select("url", "strategy", F.col("content_hash").alias("old_hash"))
    return fetched.join(old, ["url", "strategy"], "left").withColumn("unchanged", F.coalesce(F.col("old_hash") == F.sha2("content", 256), F.lit(False)))


def find_by_hash(cache: DataFrame, content_hash: str) -> DataFrame:
    return cache.where(F.col("content_hash") == content_hash)


def conditional_headers(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(cache.select("url", "strategy", "etag", "last_modified"), ["url", "strategy"], "left")


def dedup(cache: DataFrame) -> DataFrame:
    """One entry of each content hash: the most recently read, ties by url and strategy."""
    columns = [c for c in cache.columns if c != "content_hash"]
    # The smallest struct with the time negated is the latest, then the first url.
    place = F.struct((-F.unix_micros(F.to_timestamp("last_accessed_at"))).alias("t"), "url", "strategy")
    return cache.groupBy("content_hash").agg(F.min_by(F.struct(*columns), place).alias("e")).select("content_hash", "e.*").select(*cache.columns)


def status_text(n_routes: Column, n_entries: Column, n_bytes: Column) -> Column:
    return F.format_string("Route cache: %d entries\nContent cache: %d entries (%d bytes)", n_routes, n_entries, n_bytes)


def stats_text(entry_count: Column, total: Column, oldest: Column, newest: Column, tops: Column) -> Column:
    """A report; tops is an array of (domain, n)."""
    listed = F.concat(F.lit("\n**Top domains:**\n"), F.array_join(F.transform(tops, lambda t: F.format_string("- %s (%d entries)\n", t["domain"], t["n"])), ""))
    return F.concat(
        F.format_string("**Entries:** %d\n**Total size:** %d bytes (%.1f KB)\n", entry_count, total, total / 1024.0),
        F.coalesce(F.concat(F.lit("**Oldest:** "), oldest, F.lit("\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("**Newest:** "), newest, F.lit("\n")), F.lit("")),
        F.when(F.size(tops) > 0, listed).otherwise(""),
    )
