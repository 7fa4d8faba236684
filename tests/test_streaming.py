"""Streams over files against the batch operators."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import history, routes
from corvane.sources.tables import fetch_log, page_history
from corvane.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture
def log_files(spark, tmp_path):
    path = str(tmp_path / "log")
    fetch_log(spark, SF).repartition(3).write.parquet(path)
    return path


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name)


def test_route_stats_stream(spark, log_files):
    batch = spark.read.parquet(log_files)
    stream = spark.readStream.schema(batch.schema).parquet(log_files)
    got = drain(streams.route_stats(stream), "routes_stream", "update")
    want = {(r["domain"], r["strategy"]): r for r in routes.route_stats(batch).collect()}
    last = {}
    for r in got.collect():
        last[r["domain"], r["strategy"]] = r
    assert set(last) == set(want)
    for k, r in last.items():
        assert r["total_requests"] == want[k]["total_requests"] and abs(r["success_rate"] - want[k]["success_rate"]) < 1e-9
        assert r["last_check_at"] == want[k]["last_check_at"]
        assert r["avg_latency_ms"] == want[k]["avg_latency_ms"]  # one micro-batch holds all files


def test_sessions_and_blocks(spark, log_files):
    batch = spark.read.parquet(log_files)
    stream = spark.readStream.schema(batch.schema).parquet(log_files)
    got = drain(streams.sessions(stream), "sessions_stream", "append")
    assert 0 < got.agg(F.sum("n")).first()[0] <= batch.count()
    lines = stream.select("domain", F.concat(F.lit(" "), "strategy").alias("line"))
    counts = drain(streams.block_counts(lines), "blocks_stream", "complete")
    assert counts.agg(F.sum("n")).first()[0] == batch.count()


def test_diffs(spark, tmp_path):
    path = str(tmp_path / "versions")
    page_history(spark, SF).limit(40).write.parquet(path)
    schema = spark.read.parquet(path).schema
    writer = streams.store_diffs(spark.readStream.schema(schema).parquet(path), str(tmp_path / "now"), str(tmp_path / "diffs"))
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and spark.read.parquet(str(tmp_path / "diffs")).count() == 40


def test_diffs_over_several_batches(spark, tmp_path):
    """As in one batch, with only the touched parts of the store read."""
    path = tmp_path / "versions"
    path.mkdir()
    rows = page_history(spark, SF).limit(60).orderBy("id").collect()
    schema = page_history(spark, SF).schema
    writer = streams.store_diffs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path)), str(tmp_path / "now"), str(tmp_path / "diffs"))
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(path))
        query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    columns = ["url", "id", "old_hash", "new_hash", "added_lines", "removed_lines"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "diffs")).select(*columns).collect()}
    want = {tuple(r) for r in history.diffs(spark.createDataFrame(rows, schema)).select(*columns).collect()}
    assert got == want and len(got) == 60
