"""Route tables as JSON, and stores as Parquet."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from corvane.functions.batches import each_value

EXPORTED = ("domain", "strategy", "avg_latency_ms", "success_rate", "total_requests")
#: The folder of a store that lists its whole versions.
MANIFEST = "manifest"
ENTRY = "domain string, strategy string, avg_latency_ms bigint, success_rate double, total_requests int"
_PACK = "name string, version string, domains array<struct<domain:string,strategy:string>>"


def export_json(stats: DataFrame, path: str) -> None:
    """One JSON object a line, in parallel."""
    stats.select(*EXPORTED).write.mode("overwrite").json(path)


def export_text(stats: DataFrame) -> DataFrame:
    """One row with all routes as a JSON array; for tables of at most the capacity of routes."""
    rows = F.array_sort(F.collect_list(F.struct(*EXPORTED)))
    return stats.agg(F.to_json(rows, {"pretty": "true"}).alias("json"))


def read_entries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of a JSON array, or of one object a line as export_json writes them."""
    return spark.read.schema(ENTRY).option("multiLine", not lines).json(path)


def as_outcomes(entries: DataFrame, ts: Column) -> DataFrame:
    """Each entry as one outcome with its mean latency; a success if its rate is over a half."""
    return entries.select(F.xxhash64("domain", "strategy").alias("event_id"), ts.alias("ts"), "domain", "strategy", F.col("avg_latency_ms").alias("latency_ms"), (F.col("success_rate") > 0.5).alias("success"))


def replace_stats(stats: DataFrame, entries: DataFrame, ts: Column) -> DataFrame:
    """The entries take the place of rows with their keys, stamped with ts."""
    new = entries.select(*EXPORTED, ts.alias("last_success_at"), ts.alias("last_check_at"))
    return stats.join(entries.select("domain", "strategy"), ["domain", "strategy"], "left_anti").select(*new.columns).unionByName(new)


def read_pack(spark: SparkSession, path: str, ts: Column) -> DataFrame:
    """A route pack's domains as successful outcomes without latency."""
    return pack_outcomes(spark.read.schema(_PACK).option("multiLine", True).json(path), ts)


def pack_outcomes(packs: DataFrame, ts: Column) -> DataFrame:
    """As read_pack, of packs that have been read (domains: array of domain and strategy)."""
    rows = packs.select(F.explode("domains").alias("d")).select("d.*")
    return rows.select(F.xxhash64("domain", "strategy").alias("event_id"), ts.alias("ts"), "domain", "strategy", F.lit(0).cast("long").alias("latency_ms"), F.lit(True).alias("success"))


def save_store(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """Each table as Parquet under folder/table/version=n, and last the manifest that makes the version known."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}/version={version}")
    spark = next(iter(tables.values())).sparkSession
    listed = spark.createDataFrame([(name,) for name in tables], "table string")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{MANIFEST}/version={version}")


def load_store(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the newest version whose manifest has been written and names it."""
    whole = spark.read.parquet(f"{folder}/{MANIFEST}").where(F.col("table") == name)
    newest = whole.agg(F.max("version").alias("v")).first()["v"]
    return spark.read.parquet(f"{folder}/{name}/version={newest}")


@F.arrow_udf(BinaryType())
def gzip_bytes(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return each_value(x, lambda v: gzip.compress(v.as_buffer(), mtime=0), pa.binary())


@F.arrow_udf(StringType())
def gunzip_text(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return each_value(x, lambda v: gzip.decompress(v.as_buffer()).decode(), pa.string())
