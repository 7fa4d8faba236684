"""Known strategies of well-known domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import routes

LATENCY_MS = 500
#: Domains and their strategies.
SEEDS = (
    ("medium.com", "TlsChrome"),
    ("discord.com", "TlsChrome"),
    ("reddit.com", "PublicApi"),
    ("old.reddit.com", "PublicApi"),
    ("notion.so", "TlsChrome"),
    ("vercel.com", "TlsChrome"),
    ("linear.app", "TlsChrome"),
    ("figma.com", "TlsChrome"),
    ("shopify.com", "TlsChrome"),
    ("zendesk.com", "TlsChrome"),
    ("wix.com", "TlsChrome"),
    ("stripe.com", "TlsChrome"),
    ("cloudflare.com", "TlsChrome"),
    ("docs.rs", "HttpSimple"),
    ("developer.mozilla.org", "HttpSimple"),
    ("docs.python.org", "HttpSimple"),
    ("doc.rust-lang.org", "HttpSimple"),
    ("go.dev", "HttpSimple"),
    ("pkg.go.dev", "HttpSimple"),
    ("docs.oracle.com", "HttpSimple"),
    ("learn.microsoft.com", "HttpSimple"),
    ("kubernetes.io", "HttpSimple"),
    ("docs.ansible.com", "HttpSimple"),
    ("javadoc.io", "HttpSimple"),
    ("bbc.com", "HttpSimple"),
    ("reuters.com", "HttpSimple"),
    ("apnews.com", "HttpSimple"),
    ("npr.org", "HttpSimple"),
    ("theguardian.com", "HttpSimple"),
    ("arstechnica.com", "HttpSimple"),
    ("techcrunch.com", "HttpSimple"),
    ("wired.com", "HttpSimple"),
    ("theverge.com", "HttpSimple"),
    ("bloomberg.com", "Headless"),
    ("nytimes.com", "Headless"),
    ("github.com", "HttpSimple"),
    ("gitlab.com", "HttpSimple"),
    ("bitbucket.org", "HttpSimple"),
    ("codeberg.org", "HttpSimple"),
    ("sourcehut.org", "HttpSimple"),
    ("gitee.com", "HttpSimple"),
    ("stackoverflow.com", "HttpSimple"),
    ("stackexchange.com", "HttpSimple"),
    ("superuser.com", "HttpSimple"),
    ("askubuntu.com", "HttpSimple"),
    ("serverfault.com", "HttpSimple"),
    ("hackernews.com", "PublicApi"),
    ("news.ycombinator.com", "PublicApi"),
    ("youtube.com", "YouTube"),
    ("www.youtube.com", "YouTube"),
    ("youtu.be", "YouTube"),
    ("m.youtube.com", "YouTube"),
    ("crates.io", "HttpSimple"),
    ("npmjs.com", "HttpSimple"),
    ("pypi.org", "HttpSimple"),
    ("hub.docker.com", "HttpSimple"),
    ("rubygems.org", "HttpSimple"),
)


def seed_rows() -> list[tuple[str, str]]:
    return list(SEEDS)


def seed_log(spark: SparkSession) -> DataFrame:
    """The seeds as successful outcomes."""
    rows = spark.createDataFrame(seed_rows(), "domain string, strategy string")
    return rows.select(F.xxhash64("domain").alias("event_id"), F.lit("1970-01-01").cast("timestamp_ntz").alias("ts"), "domain", "strategy", F.lit(LATENCY_MS).cast("long").alias("latency_ms"), F.lit(True).alias("success"))


def import_seeds(stats: DataFrame) -> DataFrame:
    """The seeds' statistics where there are none yet."""
    return routes.route_stats(seed_log(stats.sparkSession)) if stats.isEmpty() else stats


def seed_missing(stats: DataFrame) -> DataFrame:
    """stats, and the seeds' statistics for those of their domains that have no route yet."""
    seeded = routes.route_stats(seed_log(stats.sparkSession)).join(stats.select("domain").distinct(), "domain", "left_anti")
    return stats.unionByName(seeded.select(*stats.columns))
