"""python -m corvane {list | run | routes | import-pack | status | clear | export | import | seed | migrate | settings | doctor}

A store is a folder of versioned tables (``corvane.sources.store``): routes, cache, history and evidence.
"""

from __future__ import annotations

import argparse
import importlib
import shutil
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import cache, routes
from corvane.plans import catalog
from corvane.session import build
from corvane.sources import config, route_files, seeds, store

_FIRST = "1970-01-01"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corvane", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    for name, given, text in (
        ("run", ("name", "sf_dir", "out"), "writes a query's result as Parquet"),
        ("routes", ("log", "out"), "route statistics of a fetch log, as JSON lines"),
        ("import-pack", ("pack", "out"), "route statistics of a route pack, as JSON lines"),
        ("status", ("store",), "numbers of routes, domains, cache entries and bytes"),
        ("clear", ("store",), "empties the content cache; routes stay"),
        ("export", ("store", "out"), "routes as a JSON array"),
        ("import", ("store", "entries"), "merges the routes of a JSON array as outcomes"),
        ("seed", ("store",), "seeds the routes of a store that has none"),
        ("migrate", ("store",), "rewrites the tables of older schema versions"),
    ):
        command = sub.add_parser(name, help=text)
        for x in given:
            command.add_argument(x)
    for name, text in (("settings", "the settings in force"), ("doctor", "checks of what the engine needs")):
        sub.add_parser(name, help=text).add_argument("--config")
    return parser


def open_store(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], int]:
    """Tables of the newest version (empty ones where there is none), and its number."""
    held = store.Store(spark, folder)
    return {name: held.read(name) for name in store.TABLES}, held.version


def status(spark: SparkSession, folder: str) -> str:
    tables, _ = open_store(spark, folder)
    n, domains = tables["routes"].agg(F.count(F.lit(1)), F.countDistinct("domain")).first()
    held = cache.stats(tables["cache"]).first()
    return f"Route cache:\n  Entries: {n}\n  Domains: {domains}\nContent cache:\n  Entries: {held['entry_count']}\n  Size: {held['total_size_bytes']} bytes"


def clear(spark: SparkSession, folder: str) -> None:
    held = store.Store(spark, folder)
    held.replace("cache", cache.clear(held.read("cache")))


def import_routes(spark: SparkSession, folder: str, path: str) -> int:
    """Merges entries as one outcome each; their number."""
    held, entries = store.Store(spark, folder), route_files.read_entries(spark, path)
    held.replace("routes", routes.merge_outcomes(held.read("routes"), route_files.as_outcomes(entries, F.lit(_FIRST).cast("timestamp"))))
    return entries.count()


def seed(spark: SparkSession, folder: str) -> int:
    """Seeds the routes of a store that has none; the number of routes it then has."""
    held = store.Store(spark, folder)
    known = held.read("routes")
    if known.isEmpty():
        stats = seeds.import_seeds(known)
        held.replace("routes", stats.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known.schema]))
    return held.read("routes").count()


def doctor(path: str | None) -> list[tuple[str, bool]]:
    """What the engine needs, and whether it is there."""
    out = [("java", shutil.which("java") is not None)]
    for module in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            importlib.import_module(module)
            out.append((module, True))
        except ImportError:
            out.append((module, False))
    try:
        config.load(path)
        out.append(("settings", True))
    except (config.ConfigError, OSError):
        out.append(("settings", False))
    return out


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
    elif args.command == "settings":
        print("\n".join(f"{k}: {v}" for k, v in asdict(config.load(args.config)).items()))
    elif args.command == "doctor":
        found = doctor(args.config)
        print("\n".join(f"{'ok     ' if ok else 'MISSING'} {name}" for name, ok in found))
        return 0 if all(ok for _, ok in found) else 1
    else:
        _with_session(args)
    return 0


def _with_session(args: argparse.Namespace) -> None:
    spark = build()
    if args.command == "run":
        catalog.queries()[args.name](spark, args.sf_dir).write.mode("overwrite").parquet(args.out)
    elif args.command == "routes":
        route_files.export_json(routes.route_stats(spark.read.parquet(args.log)), args.out)
    elif args.command == "import-pack":
        route_files.export_json(routes.route_stats(route_files.read_pack(spark, args.pack, F.lit(_FIRST).cast("timestamp_ntz"))), args.out)
    elif args.command == "status":
        print(status(spark, args.store))
    elif args.command == "clear":
        clear(spark, args.store)
        print("Cache cleared.")
    elif args.command == "seed":
        print(f"{seed(spark, args.store)} routes.")
    elif args.command == "migrate":
        print(f"{store.Store(spark, args.store).migrate()} tables rewritten.")
    elif args.command == "export":
        route_files.export_text(open_store(spark, args.store)[0]["routes"]).write.mode("overwrite").text(args.out)
    else:
        print(f"Imported {import_routes(spark, args.store, args.entries)} strategies from {args.entries}")


if __name__ == "__main__":
    raise SystemExit(main())
