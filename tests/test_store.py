"""Stores that are changed by copy on write and upgraded by steps; routes that hold most of the log."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.operators import routes
from corvane.sources import schemas, seeds, store

T0 = "2024-01-01 00:00:00"


def cache_rows(spark, n, mode="markdown"):
    at = F.lit(T0).cast("timestamp")
    return spark.range(n).select(
        F.concat(F.lit("https://d"), (F.col("id") % 5).cast("string"), F.lit(".example.com/"), F.col("id").cast("string")).alias("url"), F.lit("TlsChrome").alias("strategy"), F.lit(mode).alias("extraction_mode"),
        F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.col("id").cast("string").alias("content"), F.lit("text/html").alias("content_type"), F.length(F.col("id").cast("string")).cast("long").alias("original_size"),
        at.alias("created_at"), at.alias("last_accessed_at"), (at + F.make_dt_interval(F.lit(1))).alias("expires_at"), F.lit("e").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
    )


def folders(held, table="cache"):
    return {(b, folder) for name, b, folder, _ in held.parts if name == table}


@pytest.mark.parametrize("version", range(1, store.CURRENT + 1))
def test_stores_of_every_schema_version(spark, tmp_path, version):
    """A store without a list of parts, as it was before: opened, read, upgraded."""
    folder = str(tmp_path)
    rows = cache_rows(spark, 20)
    rows.select(*store.columns_of("cache", version)).write.parquet(f"{folder}/cache/version=3")
    spark.createDataFrame([("cache",)], "table string").write.parquet(f"{folder}/manifest/version=3")
    held = store.Store(spark, folder, buckets=4)
    assert [p[3] for p in held.parts] == [version]
    first = held.read("cache").orderBy("url").collect()
    assert {r["strategy"] for r in first} == {"HttpSimple" if version < 3 else "TlsChrome"} and {r["extraction_mode"] for r in first} == {"markdown"}
    assert {r["etag"] for r in first} == {None if version < 2 else "e"}
    assert held.read("history").count() == held.read("routes").count() == 0
    assert held.migrate() == 1 and held.migrate() == 0
    again = store.Store(spark, folder, buckets=4)
    assert again.version == 4 and {p[3] for p in again.parts} == {store.CURRENT}
    assert again.read("cache").orderBy("url").collect() == first
    assert store.Store(spark, folder, version=3).read("cache").orderBy("url").collect() == first


def test_changes_rewrite_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path)
    held = store.Store(spark, folder, buckets=8)
    assert held.read("cache").count() == 0
    held.put(cache_rows(spark, 60), 3600)
    before, old = folders(held), store.Store(spark, folder, buckets=8)
    one = cache_rows(spark, 1).withColumn("content", F.lit("changed")).withColumn("created_at", F.lit("2024-02-01").cast("timestamp"))
    held.put(one, 3600)
    assert len(before - folders(held)) == 1 == len(folders(held) - before)
    rows = {r["url"]: r["content"] for r in store.Store(spark, folder, buckets=8).read("cache").collect()}
    assert len(rows) == 60 and rows["https://d0.example.com/0"] == "changed"
    # Who opened the store before the change goes on reading what was there.
    assert {r["content"] for r in old.read("cache").where("url = 'https://d0.example.com/0'").collect()} == {"0"}
    kept = folders(held)
    held.remove("cache", F.col("url") == "https://d1.example.com/1")
    assert len(kept - folders(held)) == 1 and held.read("cache").count() == 59
    held.remove("cache", F.col("url") == "https://nowhere")
    assert held.version == 3 and held.read("cache").count() == 59
    held.remove("cache", F.col("expires_at") <= F.lit("2024-01-15").cast("timestamp"))
    assert [r["content"] for r in held.read("cache").collect()] == ["changed"]
    held.remove("cache", F.lit(True))
    assert store.Store(spark, folder, buckets=8).read("cache").count() == 0


def test_versions_and_evidence_are_added(spark, tmp_path):
    held = store.Store(spark, str(tmp_path), buckets=4)
    rows = spark.range(40).select(F.col("id"), F.when(F.col("id") % 2 == 0, "https://hot").otherwise(F.concat(F.lit("https://"), "id")).alias("url"), F.lit("h").alias("content_hash"), F.lit("b").alias("content_body"), F.lit("s").alias("strategy"), F.timestamp_seconds("id").alias("fetched_at"))
    held.add_versions(rows.where("id < 30"), keep=3)
    held.add_versions(rows.where("id >= 30"), keep=3)
    found = held.read("history").collect()
    assert sorted(r["id"] for r in found if r["url"] == "https://hot") == [34, 36, 38] and len(found) == 23
    note = spark.createDataFrame([("https://hot", "h", "s", None, "high", [])], schemas.EVIDENCE)
    held.append("evidence", note)
    first = folders(held, "evidence")
    held.append("evidence", note)
    assert first < folders(held, "evidence") and held.read("evidence").count() == 2


def test_seeding_a_store_that_is_empty(spark, tmp_path):
    from corvane import __main__ as cli

    assert cli.seed(spark, str(tmp_path)) == len(seeds.seed_rows()) == cli.seed(spark, str(tmp_path))
    assert store.Store(spark, str(tmp_path)).version == 1


# --- routes ---


def plain_mean(latencies, mean=0, n=0):
    for x in latencies:
        mean, n = (None if mean is None or x is None else int((mean * n + x) / (n + 1)), n + 1)
    return mean


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_route_of_half_the_log_is_folded_in_order(spark, monkeypatch, adaptive):
    monkeypatch.setattr(routes, "BLOCK", 50)
    rng = random.Random(7)
    rows = [(i, f"2024-01-01 00:00:{rng.randint(0, 59):02d}", "hot" if i % 2 else rng.choice(["a", "b", None]), rng.choice(["HttpSimple", None]) if i % 2 == 0 else "Headless", rng.randint(-50, 9000), i % 3 > 0) for i in range(4000)]
    rows += [(9001, "2024-01-01", "c", "Headless", None, True), (9002, "2024-01-02", "c", "Headless", 5, True)]
    log = spark.createDataFrame(rows, "event_id bigint, ts string, domain string, strategy string, latency_ms bigint, success boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(9)
    by_route = defaultdict(list)
    for i, ts, domain, strategy, latency, _ in rows:
        by_route[domain, strategy].append((ts if len(ts) > 10 else f"{ts} 00:00:00", i, latency))
    expected = {k: plain_mean([x for *_, x in sorted(v)]) for k, v in by_route.items()}
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        found = routes.route_stats(log).collect()
        assert {(r.domain, r.strategy): r.avg_latency_ms for r in found} == expected and len(found) == len(expected)
        assert Counter({(r.domain, r.strategy): r.total_requests for r in found}) == Counter((r[2], r[3]) for r in rows)
        first = routes.route_stats(log.where("event_id < 2000"))
        merged = routes.merge_outcomes(first, log.where("event_id >= 2000")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    halves = {k: plain_mean([x for _, i, x in sorted(v) if i >= 2000], *((plain_mean([x for _, i, x in sorted(v) if i < 2000]), sum(i < 2000 for _, i, _ in v)))) for k, v in by_route.items()}
    assert {(r.domain, r.strategy): r.avg_latency_ms for r in merged} == halves


# --- batches ---


def test_batches_of_any_size(spark):
    from corvane.operators import extraction

    rows = [(1, k, f"t{k}" if k != 3 else None) for k in range(10)] + [(2, k, "x") for k in range(5000)] + [(None, 0, "alone"), (3, 1, "tie"), (3, 1, "again")]
    found = {r.batch: (r.combined, r.error) for r in extraction.combine(spark.createDataFrame(rows, "batch int, pos int, text string").repartition(5)).collect()}
    assert found[1] == ("\n\n---\n\n".join(f"t{k}" if k != 3 else "" for k in range(10)), None)
    assert found[2] == (None, "Maximum 10 URLs per batch") and found[None] == ("alone", None) and found[3] == ("again\n\n---\n\ntie", None)
    item = extraction.item_text(F.col("t"), F.lit("u"), F.col("w"), F.col("e"), F.col("x"), F.lit(3))
    rows = [("text", None, None, False), ("long text here", "few", None, False), ("t", None, "no", True), (None, "w", "no", False), (None, None, None, None)]
    shown = [r[0] for r in spark.createDataFrame(rows, "t string, w string, e string, x boolean").coalesce(1).select(item).collect()]
    assert shown == ["text", "long text he\n\n[... truncated to fit token budget]", "[fetch error for u: all strategies exhausted: no]", "[fetch error for u: no]", ""]


def test_best_routes_of_equal_scores_by_name(spark):
    rows = [("d", n, 100, 0.5) for n in ("Zeta", "Own", "TlsChrome", "Another")] + [("e", "Own", None, None), ("e", "Headless", 900, 0.0)]
    found = {r.domain: r.strategy for r in routes.best(spark.createDataFrame(rows, "domain string, strategy string, avg_latency_ms bigint, success_rate double").repartition(4)).collect()}
    assert found == {"d": "Another", "e": "Headless"}
