"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from corvane.plans import corpus_queries, page_queries, store_queries
from corvane.plans.base import Query

_PARTS = (page_queries.catalog, store_queries.catalog, corpus_queries.catalog)


def queries() -> dict[str, Query]:
    return {k: f for part in _PARTS for k, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.sql.items()}
