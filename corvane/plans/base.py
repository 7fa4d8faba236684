"""Query registration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    """Queries by name, with SQL where it can express them."""

    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


#: White space, for RE2.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def sql_lines(x: str) -> str:
    """Lines as in corvane.functions.text.lines."""
    parts = f"string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10))"
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN list_last({parts}) = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


def sql_domain(x: str) -> str:
    return f"nullif(regexp_extract({x}, '^https?://([^/:]*)', 1), '')"


def sql_prefix(x: str, n: str) -> str:
    """The longest prefix of whole characters of at most n bytes."""

    def inside(k: str) -> str:
        return f"substr(hex({x}), (2 * ({k}) - 1)::BIGINT, 1) IN ('8', '9', 'A', 'B')"

    cut = f"CASE WHEN NOT {inside(f'{n} + 1')} THEN {n} WHEN NOT {inside(n)} THEN {n} - 1 WHEN NOT {inside(f'{n} - 1')} THEN {n} - 2 ELSE {n} - 3 END"
    return f"(CASE WHEN strlen({x}) <= {n} THEN {x} ELSE decode(unhex(left(hex({x}), (2 * ({cut}))::BIGINT))) END)"


def sql_clean(x: str) -> str:
    """Markdown clean-up as in corvane.functions.markdown.clean."""
    for pattern, with_ in ((r"\\([^*_#\[\]\\`~\s])", r"\1"), (r"(?m)^(#{1,6})([^ \n#])", r"\1 \2"), (r"\[([^\]]*)\]\(\)", r"\1"), (r"\n{4,}", "\n\n\n")):
        x = f"regexp_replace({x}, '{pattern}', '{with_}', 'g')"
    return sql_trim(x)
