"""Readers of the driver's tables, and the engine's own tables derived from them.

The mappings are fixed arithmetic on existing columns, so that any engine can
state them: fetch logs from events, cache entries and page versions from documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import ship
from corvane.operators.routes import STRATEGIES

#: The instant that stands for "now" in queries.
NOW = "2024-03-01 00:00:00"
EPOCH = "2024-01-01 00:00:00"

FETCH_LOG_SQL = """
SELECT event_id, ts, 'd' || (user_id % 20)::VARCHAR || '.example.com' AS domain,
  ['HttpSimple','TlsChrome','TlsMobile','Headless','PublicApi','YouTube'][(event_id % 6 + 1)::INT] AS strategy,
  floor(value * 10)::BIGINT AS latency_ms, regexp_extract(props, '(\\d+)', 1)::BIGINT % 4 <> 0 AS success,
  [200, 403, 404, 429, 503, 200][(regexp_extract(props, '(\\d+)', 1)::BIGINT % 6 + 1)::INT] AS status, event_type
FROM events
""".replace("\\\\", "\\")

URL_CACHE_SQL = """
SELECT doc_id, 'https://' || source || '.example.com/p/' || doc_id::VARCHAR AS url,
  ['HttpSimple','TlsChrome','Headless'][(doc_id % 3 + 1)::INT] AS strategy, 'markdown' AS extraction_mode,
  sha256(text) AS content_hash, text AS content, 'text/html' AS content_type, strlen(text)::BIGINT AS original_size,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 7919 % 5000000) AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 7919 % 5000000 + doc_id * 31 % 86400) AS last_accessed_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 7919 % 5000000 + (doc_id % 60) * 86400) AS expires_at
FROM documents WHERE text IS NOT NULL
"""

PAGE_HISTORY_SQL = """
SELECT doc_id AS id, 'https://' || source || '.example.com/' || lang AS url, sha256(text) AS content_hash, text AS content_body,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60) AS fetched_at
FROM documents WHERE text IS NOT NULL
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows in several tasks for each core: a small file of many rows is one task, however long its rows' work takes."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    statuses = F.array(*map(F.lit, (200, 403, 404, 429, 503, 200)))
    return e.select(
        "event_id",
        "ts",
        F.concat(F.lit("d"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com")).alias("domain"),
        F.get(F.array(*map(F.lit, STRATEGIES)), (F.col("event_id") % 6).cast("int")).alias("strategy"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"),
        (k % 4 != 0).alias("success"),
        F.get(statuses, (k % 6).cast("int")).alias("status"),
        "event_type",
    )


def _after(seconds) -> F.Column:
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def url_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents").where("text is not null"), F.col("doc_id")
    made = i * 7919 % 5_000_000
    return d.select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/p/"), i.cast("string")).alias("url"),
        F.get(F.array(*map(F.lit, ("HttpSimple", "TlsChrome", "Headless"))), (i % 3).cast("int")).alias("strategy"),
        F.lit("markdown").alias("extraction_mode"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("text").alias("content"),
        F.lit("text/html").alias("content_type"),
        F.octet_length("text").cast("long").alias("original_size"),
        _after(made).alias("created_at"),
        _after(made + i * 31 % 86400).alias("last_accessed_at"),
        _after(made + i % 60 * 86400).alias("expires_at"),
        F.concat(F.lit('"'), F.left(F.sha2("text", 256), F.lit(8)), F.lit('"')).alias("etag"),
        F.when(i % 2 == 0, F.lit("Mon, 01 Jan 2024 00:00:00 GMT")).alias("last_modified"),
    )


def page_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang").alias("url"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content_body"), _after(F.col("doc_id") * 60).alias("fetched_at"))


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")
