"""Stores: a folder of versioned Parquet tables, changed by copy on write and upgraded by steps.

``manifest/version=n`` lists the parts of version n: table, bucket, folder and the schema
version that the part was written in.  A change writes new folders for the buckets that it
touches and then a manifest that names them beside the untouched ones; the manifest is
one file, written last, so a version is there as a whole or not at all, and whoever reads
an older version goes on reading it.  Keyed tables are dealt into buckets by a hash of
the url, so a put or a removal rewrites the buckets of its urls alone; rows that are only
added (versions of pages, evidence) get folders of their own beside the old ones.

``STEPS`` is the ledger of schema versions: what each step adds to a table.  Parts of
older versions are read alike, with the steps applied as columns, and ``migrate`` rewrites
them.  Stores without this bookkeeping (one folder a table) are read too, their schema
version told from their columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import cache, history
from corvane.sources import schemas

MANIFEST = "manifest"
_ROWS = "table string, bucket int, folder string, schema_version int"
BUCKETS = 64
TABLES = {"routes": schemas.ROUTE_STATS, "cache": schemas.URL_CACHE, "history": schemas.PAGE_HISTORY, "evidence": schemas.EVIDENCE}
#: Tables that are dealt into buckets by url; the others are small and one part.
KEYED = ("cache", "history", "evidence")


@dataclass(frozen=True)
class Step:
    """One schema version: columns (with their values for older rows) that it adds to tables, and tables that begin with it."""

    version: int
    name: str
    columns: dict[str, dict[str, str]]
    tables: tuple[str, ...] = ()


#: The ledger, in order; values are SQL.
STEPS = (
    Step(1, "initial", {}, ("routes", "cache")),
    Step(2, "conditional requests", {"cache": {"etag": "CAST(NULL AS STRING)", "last_modified": "CAST(NULL AS STRING)"}}),
    Step(3, "strategy in the key", {"cache": {"strategy": "'HttpSimple'"}}),
    Step(4, "modes, evidence and page versions", {"cache": {"extraction_mode": "'markdown'"}}, ("history", "evidence")),
)
CURRENT = STEPS[-1].version


def columns_of(table: str, version: int = CURRENT) -> list[str]:
    """A table's columns in a schema version."""
    later = {c for s in STEPS if s.version > version for c in s.columns.get(table, {})}
    return [f.split()[0] for f in _fields(table) if f.split()[0] not in later]


def _fields(table: str) -> list[str]:
    """The fields of a schema text, split at its outer commas."""
    out, depth = [""], 0
    for c in TABLES[table]:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def upgrade(df: DataFrame, table: str, version: int) -> DataFrame:
    """Rows of a schema version as rows of the current one; a column that is there already keeps its values."""
    for step in STEPS:
        if step.version > version:
            for column, value in step.columns.get(table, {}).items():
                if column not in df.columns:
                    df = df.withColumn(column, F.expr(value))
    return df.select(*[f.split()[0] for f in _fields(table)])


def version_of(columns: list[str], table: str) -> int:
    """The newest schema version whose columns are all there."""
    return max((s.version for s in STEPS if set(columns_of(table, s.version)) <= set(columns)), default=1)


class Store:
    """One store, read as of its newest version when it was opened or last changed."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, version: int | None = None):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.version, self.parts = 0, []
        if self._exists(MANIFEST):
            listed = spark.read.schema(f"{_ROWS}, version int").parquet(f"{self.folder}/{MANIFEST}")
            self.version = version or listed.agg(F.max("version").alias("v")).first()["v"] or 0
            # A row a bucket and table: the folder names, no data.
            self.parts = [self._known(r) for r in listed.where((F.col("version") == self.version) & (F.col("table") != "")).collect()]

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _known(self, row) -> tuple[str, int, str, int]:
        """A part as (table, bucket, folder, schema version); bucket -1 is a whole table."""
        if row["folder"] is not None:
            return row["table"], row["bucket"], row["folder"], row["schema_version"]
        folder = f"{row['table']}/version={self.version}"
        return row["table"], -1, folder, version_of(self.spark.read.parquet(f"{self.folder}/{folder}").columns, row["table"])

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """A table in the current schema, from parts of any version; of some buckets alone if they are given."""
        found: dict[int, list[str]] = {}
        for name, bucket, folder, version in self.parts:
            if name == table and (buckets is None or bucket in buckets or bucket == -1):
                found.setdefault(version, []).append(f"{self.folder}/{folder}")
        out = self.spark.createDataFrame([], TABLES[table])
        for version, folders in sorted(found.items()):
            out = out.unionByName(upgrade(self.spark.read.parquet(*folders), table, version))
        whole = any(name == table and bucket == -1 for name, bucket, _, _ in self.parts)
        return out.where(self.bucket(F.col("url")).isin(*buckets)) if whole and buckets is not None and table in KEYED else out

    def _commit(self, table: str, rows: DataFrame, replaced: Callable[[int], bool]) -> None:
        """Writes rows as new parts, and a manifest with them in place of the parts whose bucket is replaced."""
        version, new = self.version + 1, f"{table}/version={self.version + 1}"
        shown = rows.select(*[f.split()[0] for f in _fields(table)])
        if table in KEYED:
            # Ranges of (bucket, url): few files a task, and a large bucket is several.
            dealt = shown.withColumn("bucket", self.bucket(F.col("url"))).repartitionByRange("bucket", "url")
            dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{new}")
            written = [r["bucket"] for r in self.spark.read.parquet(f"{self.folder}/{new}").select("bucket").distinct().collect()] if self._any(new) else []
            added = [(table, b, f"{new}/bucket={b}", CURRENT) for b in written]
        else:
            shown.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{new}")
            added = [(table, 0, new, CURRENT)]
        parts = [p for p in self.parts if p[0] != table or not replaced(p[1])] + added
        # A row without a table, so that a version without any part is there too.
        listed = self.spark.createDataFrame([*parts, ("", -2, "", CURRENT)], _ROWS)
        listed.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/{MANIFEST}/version={version}")
        self.version, self.parts = version, parts

    def _any(self, name: str) -> bool:
        """Whether a written folder has any bucket."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return any("bucket=" in x.getPath().getName() for x in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path))

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r["b"] for r in rows.select(self.bucket(F.col("url")).alias("b")).distinct().collect()}

    def change(self, table: str, touched: DataFrame, new: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrites the buckets of the touched urls as ``new`` makes them of their rows."""
        buckets = self._touched(touched)
        if not buckets:
            return
        whole = any(name == table and bucket == -1 for name, bucket, _, _ in self.parts)
        old = self.read(table, None if whole else buckets)
        self._commit(table, new(old), lambda b: b == -1 or b in buckets)

    def replace(self, table: str, rows: DataFrame) -> None:
        """All rows of a table."""
        self._commit(table, rows, lambda b: True)

    def append(self, table: str, rows: DataFrame) -> None:
        """More rows of a keyed table; nothing that is there is read or rewritten."""
        self._commit(table, rows, lambda b: False)

    def put(self, entries: DataFrame, ttl_seconds: int, strict_parity: bool = False) -> None:
        """New cache entries; the latest of a key wins."""
        self.change("cache", entries, lambda old: cache.put(old, entries, ttl_seconds, strict_parity))

    def remove(self, table: str, gone: Column) -> None:
        """Takes out the rows where ``gone`` holds; only urls are read to find their buckets, where the condition needs no more."""
        self.change(table, self.read(table).where(gone).select("url"), lambda old: old.where(~F.coalesce(gone, F.lit(False))))

    def add_versions(self, rows: DataFrame, keep: int = history.KEPT_VERSIONS) -> None:
        """New page versions; of each touched url the newest are kept."""
        self.change("history", rows, lambda old: history.newest(old.unionByName(rows.select(*old.columns)), keep))

    def migrate(self) -> int:
        """Rewrites the parts of older schema versions; the number of tables that had any."""
        stale = sorted({name for name, bucket, _, version in self.parts if version < CURRENT or (bucket == -1 and name in KEYED)})
        for table in stale:
            whole = any(name == table and bucket == -1 for name, bucket, _, _ in self.parts)
            buckets = {b for name, b, _, version in self.parts if name == table and version < CURRENT}
            rows = self.read(table) if whole or table not in KEYED else self.read(table, buckets)
            self._commit(table, rows, (lambda b: True) if whole or table not in KEYED else lambda b, held=buckets: b in held)
        return len(stale)
