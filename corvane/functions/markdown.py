"""Markdown clean-up (M1-M5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import trim_space


def unescape(x: Column) -> Column:
    """Backslashes go, except before Markdown's own characters, white space and the end."""
    return F.regexp_replace(x, r"\\([^*_#\[\]\\`~\s])", "$1")


def space_headings(x: Column) -> Column:
    return F.regexp_replace(x, r"(?m)^(#{1,6})([^ \n#])", "$1 $2")


def drop_empty_links(x: Column) -> Column:
    return F.regexp_replace(x, r"\[([^\]]*)\]\(\)", "$1")


def collapse_blank_lines(x: Column) -> Column:
    return F.regexp_replace(x, "\n{4,}", "\n\n\n")


def clean(x: Column) -> Column:
    return trim_space(collapse_blank_lines(drop_empty_links(space_headings(unescape(x)))))
