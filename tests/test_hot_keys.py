"""Operators on tables in which one key, instant, day or line holds most of the rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import boilerplate, cache, evidence, history
from corvane.operators.ordering import range_of, split_points
from test_operators import CACHE

START = datetime.datetime(2024, 1, 1)


def cached(spark, n, seed, instants):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        read = None if i % 50 == 7 else START + datetime.timedelta(seconds=rng.randrange(instants))
        rows.append((f"https://host.example/page/{rng.randrange(10**6)}-{i}", rng.choice("AB"), "markdown", None, None, "t", rng.choice((0, 0, 3, 10, None, rng.randrange(200))), START, read, START, None, None))
    return spark.createDataFrame(rows, CACHE), rows


@pytest.mark.parametrize("instants", (1, 10**6))
@pytest.mark.parametrize("buckets, few", ((4, 9), (60, 20), (64, 1 << 16)))
def test_eviction_of_reads_of_one_second(spark, instants, buckets, few):
    df, rows = cached(spark, 700, instants, instants)
    order = sorted(rows, key=lambda r: (r[8] or datetime.datetime.min, r[0], r[1]))
    total = sum(r[6] or 0 for r in rows)
    for most in (0, total // 3, total):
        want, before = set(), 0
        for r in order:
            if before >= total - most:
                want.add(r[0])
            before += r[6] or 0
        assert {r["url"] for r in cache.evict_lru(df, most, buckets, few).select("url").collect()} == want


def test_eviction_keeps_nothing_of_nothing_and_moves_no_rows(spark):
    empty = spark.createDataFrame([], CACHE)
    assert cache.evict_lru(empty, 0).collect() == [] and cache.evict_lru(empty, 0).columns == empty.columns
    df, _ = cached(spark, 50, 1, 5)
    same = df.unionByName(df)  # entries of one key go or stay together
    kept = cache.evict_lru(same, 300).groupBy("url", "strategy").count().collect()
    assert {r["count"] for r in kept} <= {2}
    one = df.limit(1)
    for _ in range(5):
        one = one.unionByName(one)
    assert cache.evict_lru(one.withColumn("original_size", F.lit(2).cast("long")), 63, 4, 8).collect() == []
    plan = cache.evict_lru(df, 300)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_ranges_hold_equal_numbers_of_rows(spark):
    rows = spark.range(20_000).select(F.struct(F.lit("one day").alias("a"), F.sha1(F.col("id").cast("string")).alias("b")).alias("k"))
    dealt = rows.withColumn("r", range_of(F.col("k"), split_points(rows, "k", 100, 1000)))
    sizes = [r["count"] for r in dealt.groupBy("r").count().collect()]
    assert sum(sizes) == 20_000 and 60 < len(sizes) < 150 and max(sizes) < 2000
    # In order: every range ends before the next begins.
    ends = dealt.groupBy("r").agg(F.min("k.b").alias("x"), F.max("k.b").alias("y")).orderBy("r").collect()
    assert all(a["y"] < b["x"] for a, b in zip(ends, ends[1:]))


def test_evidence_of_one_day_is_numbered_in_order(spark):
    schema = "id long, url string, content_hash string, retrieved_at string"
    rng = random.Random(3)
    rows = [(rng.choice(("u", f"u{i}", None)), f"h{i:05d}", f"2024-05-01T00:00:0{rng.randrange(2)}Z") for i in range(3000)]
    old = spark.createDataFrame([(41, "x", "h", "2024-04-30T00:00:00Z")], schema)
    new = spark.createDataFrame(rows, "url string, content_hash string, retrieved_at string").repartition(7)
    want = {r: 42 + i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0] or "", r[1])))}
    for ranges, few in ((4, 10), (256, 10), (256, 1 << 16)):
        got = {(r["url"], r["content_hash"], r["retrieved_at"]): r["id"] for r in evidence.append(old, new, ranges, few).where("id > 41").collect()}
        assert got == want
    assert evidence.append(old, new.limit(0)).count() == 1
    assert [r["id"] for r in evidence.append(old.limit(0), new.limit(2)).orderBy("id").collect()] == [1, 2]


def versions(spark, n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        url = "https://hot.example/" if i % 2 else f"https://a.example/{rng.randrange(60)}"
        body = None if i % 37 == 0 else "\n".join(f"line {rng.randrange(12)}" for _ in range(rng.randrange(9)))
        rows.append((i, None if i % 41 == 0 else url, START + datetime.timedelta(minutes=rng.randrange(50)), f"hash {body}", body))
    return spark.createDataFrame(rows, "id long, url string, fetched_at timestamp_ntz, content_hash string, content_body string").repartition(5), rows


def test_versions_of_one_url(spark):
    df, rows = versions(spark)
    by_url = {}
    for r in rows:
        by_url.setdefault(r[1], []).append(r)
    want, ranks = {}, {}
    for url, own in by_url.items():
        own.sort(key=lambda r: (r[2], r[0]))
        for k, r in enumerate(own):
            before = own[k - 1] if k else None
            x, y = ((r[4] or "").split("\n") if r[4] else [], (before[4] or "").split("\n") if before and before[4] else [])
            both = r[4] is not None and before is not None and before[4] is not None
            want[url, r[0]] = (before and before[3], r[3], sum(v not in y for v in x) if both else 0, sum(v not in x for v in y) if both else 0)
            if len(own) - k <= 10:
                ranks[url, r[0]] = (len(own) - k, r[4])
    got = history.diffs(df)
    assert {(r["url"], r["id"]): (r["old_hash"], r["new_hash"], r["added_lines"], r["removed_lines"]) for r in got.collect()} == want
    assert {(r["url"], r["id"]): (r["rank"], r["content_body"]) for r in history.newest(df).collect()} == ranks
    assert history.newest(df).columns == [*df.columns, "rank"] and history.diffs(df.limit(0)).collect() == []


def test_no_body_is_in_a_window(spark):
    df, _ = versions(spark, 20)
    for plan in (history.diffs(df), history.newest(df)):
        lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = next(i for i, x in enumerate(lines) if "Window" in x)
        below = [x for x in lines[at : at + 3] if "content_body" in x]
        assert below == []


def test_a_line_on_every_page(spark):
    docs = spark.range(500).select(F.lit("d.example").alias("domain"), F.col("id"), F.concat(F.lit("menu\nown "), F.col("id").cast("string"), F.lit("\n\nfoot")).alias("text"))
    counts = boilerplate.block_counts(boilerplate.exploded(docs, "domain", "id", "text"), "domain")
    got = {r["id"]: r["text"] for r in boilerplate.strip(docs, boilerplate.boilerplate(counts), "domain", "id", "text").collect()}
    assert got == {i: f"own {i}\n" for i in range(500)}
