"""Text helpers shared by all expressions.  All lengths are bytes unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: White space of the Unicode standard, as an explicit class for both regex engines.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters, for functions that take characters instead of patterns.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trim_space(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def collapse_space(x: Column) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def lines(x: Column) -> Column:
    """Lines without their ends: a last empty piece is no line, a carriage return before the end is dropped."""

    def without_last(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    parts = F.split(F.replace(x, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(let(parts, without_last))


def is_blank(x: Column) -> Column:
    return ~F.rlike(x, F.lit(f"[^\\t-\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]"))


def non_blank_lines(x: Column) -> Column:
    return F.size(F.filter(lines(x), lambda line: ~is_blank(line)))


def bytes_of(x: Column) -> Column:
    return F.octet_length(x).cast("long")


def byte_prefix(x: Column, n: Column | int) -> Column:
    """The longest prefix of whole characters of at most n bytes."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("int")
    raw = F.encode(x, "UTF-8")
    # A cut is between characters unless a continuation byte follows it; a character has at most three of them.
    inside = lambda k: F.hex(F.substr(raw, k, F.lit(1))).substr(1, 1).isin("8", "9", "A", "B")
    cut = F.when(~inside(n + 1), n).when(~inside(n), n - 1).when(~inside(n - 1), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(x) <= n, x).otherwise(F.decode(F.substr(raw, F.lit(1), cut), "UTF-8"))


def contains_any(x: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(x, F.lit(needle))
    return out


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"
