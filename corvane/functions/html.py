"""HTML and JSON to text (X3-X15), by regular expressions over the source; no document tree is built."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corvane.functions.text import collapse_space, let, trim_space
from corvane.functions.urls import title_from_url

#: What html mode drops.
PAGE_FURNITURE = ("script", "style", "nav", "footer", "header", "noscript", "iframe", "svg")
#: Texts for pages without the wanted parts.
NO_LINKS = "No links found on this page."
NO_METADATA = "No metadata found on this page."
NO_JSONLD = "No structured data (JSON-LD) found on this page."
NO_TABLES = "No tables found on this page."
META_NAMES = ("description", "author", "keywords")


def drop_pattern(tags: tuple[str, ...]) -> str:
    closed = "|".join(f"<{t}.*?</{t}>" for t in tags)
    return f"(?is){closed}|" + "|".join(f"<{t}[^>]*>" for t in tags)


#: Private-use characters that mark start tags without an end tag while elements are dropped; a page's own are doubled up first.
_MARK, _OWN, _LONE = "\ue000", "\ue000\ue001", "\ue000\ue002"


def through_last(x: Column, closer: str) -> Column:
    """The text through the last match of an end pattern; empty without one.  One search from the end."""
    return F.regexp_extract(x, f"(?is)^.*{closer}", 0)


def _mark_unclosed(given: Column, tag: str) -> Column:
    """Start tags after the last end tag of their kind are marked."""

    def marked(x: Column) -> Column:
        return let(through_last(x, f"</{tag}>"), lambda head: F.concat(head, F.regexp_replace(F.substr(x, F.length(head) + 1), f"(?i)<({tag})", f"<{_LONE}$1")))

    return let(given, marked)


def drop_elements(x: Column, tags: tuple[str, ...]) -> Column:
    """Elements by tag prefix, through the first end tag; of an unclosed one the start tag alone.

    An end tag is searched for only where there is one: start tags behind the last end tag
    of their kind are marked before, and what follows the last ">" holds no tag.  So the
    time is in proportion to the text, however many tags aren't closed.
    """

    def dropped(text: Column) -> Column:
        marked = F.replace(text, F.lit(_MARK), F.lit(_OWN))
        for tag in tags:
            marked = _mark_unclosed(marked, tag)
        closed = "|".join(f"<{t}.*?</{t}>" for t in tags)
        gone = let(marked, lambda m: let(F.regexp_extract(m, "(?s)^.*>", 0), lambda head: F.concat(F.regexp_replace(head, f"(?is)<{_LONE}[^>]*>|{closed}", ""), F.substr(m, F.length(head) + 1))))
        return F.replace(F.replace(gone, F.lit(_LONE), F.lit("")), F.lit(_OWN), F.lit(_MARK))

    return F.when(F.rlike(x, F.lit(f"(?i)<({'|'.join(tags)})")), let(x, dropped)).otherwise(x)


def drop_comments(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)<!--.*?(-->|\z)", "")


def strip_tags(x: Column) -> Column:
    return F.replace(F.regexp_replace(x, r"<[^>]*(>|\z)", ""), F.lit(">"), F.lit(""))


def title(x: Column) -> Column:
    """Text of the title element, or null."""
    # Only the first start tag can match: where it has no end tag behind it, no later one has.
    raw = F.regexp_extract(F.regexp_extract(x, "(?is)<title.*", 0), r"(?is)^<title[^>]*>(.*?)</title>", 1)
    return F.when(raw != "", trim_space(raw))


def title_or_url(x: Column, url: Column) -> Column:
    return F.coalesce(title(x), title_from_url(url))


def text_mode(x: Column) -> Column:
    return F.nullif(collapse_space(strip_tags(drop_elements(x, ("script", "style")))), F.lit(""))


def html_mode(x: Column) -> Column:
    return F.nullif(trim_space(drop_comments(drop_elements(x, PAGE_FURNITURE))), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute's value, double quotes first; null without one."""
    double, single = f'(?is){name}="([^"]*)"', f"(?is){name}='([^']*)'"
    return F.when(F.rlike(tag, F.lit(double)), F.regexp_extract(tag, double, 1)).when(F.rlike(tag, F.lit(single)), F.regexp_extract(tag, single, 1))


def anchors(x: Column) -> Column:
    """Array of (text, href) of links; without empty and fragment-only targets."""
    pattern = F.lit(r"(?is)<a[ \t]([^>]*)>(.*?)</a>")
    closed = through_last(x, "</a>")
    pairs = F.arrays_zip(F.regexp_extract_all(closed, pattern, F.lit(1)).alias("tag"), F.regexp_extract_all(closed, pattern, F.lit(2)).alias("body"))

    def link(p: Column) -> Column:
        href, text = attribute(p["tag"], "href"), trim_space(strip_tags(p["body"]))
        return F.struct(F.when(text == "", href).otherwise(text).alias("text"), href.alias("href"))

    return F.filter(F.transform(pairs, link), lambda a: a["href"].isNotNull() & (a["href"] != "") & ~F.startswith(a["href"], F.lit("#")))


def links_mode(x: Column) -> Column:
    found = anchors(x)
    shown = F.array_join(F.transform(found, lambda a: F.concat(F.lit("- ["), a["text"], F.lit("]("), a["href"], F.lit(")"))), "\n")
    return F.when(F.size(found) == 0, F.lit(NO_LINKS)).otherwise(shown)


def _tags(x: Column, name: str) -> Column:
    return F.regexp_extract_all(x, F.lit(f"(?is)<{name} [^>]*>"), F.lit(0))


def _entry(key, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))


def _none() -> Column:
    return F.array().cast("array<struct<key:string,value:string>>")


def _one(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(_entry(key, value))).otherwise(_none())


def meta_by_name(x: Column, name: str) -> Column:
    """Content of the first meta tag of this name that has one."""
    wanted = F.filter(_tags(x, "meta"), lambda t: F.rlike(t, F.lit(f"(?i)name=[\"']{name}[\"']")) & attribute(t, "content").isNotNull())
    return attribute(F.try_element_at(wanted, F.lit(1)), "content")


def og_tags(x: Column) -> Column:
    """(property, content) of Open Graph tags, the first of each property."""
    found = F.filter(F.transform(_tags(x, "meta"), lambda t: _entry(attribute(t, "property"), attribute(t, "content"))), lambda e: F.coalesce(F.startswith(e["key"], F.lit("og:")), F.lit(False)) & e["value"].isNotNull())
    keys = F.transform(found, lambda e: e["key"])
    return F.filter(found, lambda e, i: F.array_position(keys, e["key"]) == i + 1)


def canonical(x: Column) -> Column:
    wanted = F.filter(_tags(x, "link"), lambda t: F.rlike(t, F.lit("(?i)rel=[\"']canonical[\"']")) & attribute(t, "href").isNotNull())
    return attribute(F.try_element_at(wanted, F.lit(1)), "href")


def times(x: Column) -> Column:
    found = F.transform(F.regexp_extract_all(through_last(x, "</time>"), F.lit(r"(?is)<time[^>]*>(.*?)</time>"), F.lit(1)), lambda t: _entry("time", trim_space(t)))
    return F.filter(found, lambda e: e["value"] != "")


def metadata(x: Column) -> Column:
    """Ordered (key, value) entries of a page's head."""
    named = [_one(n, meta_by_name(x, n)) for n in META_NAMES]
    return F.concat(_one("title", title(x)), *named, og_tags(x), _one("canonical", canonical(x)), times(x))


def metadata_mode(x: Column) -> Column:
    found = metadata(x)
    return F.when(F.size(found) == 0, F.lit(NO_METADATA)).otherwise(F.array_join(F.transform(found, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"))


def _no_constant(name: str):
    raise ValueError(f"{name} isn't JSON")


def _pretty(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        return json.dumps(json.loads(raw, parse_constant=_no_constant), indent=2, sort_keys=True, ensure_ascii=False)
    except (ValueError, RecursionError):
        return raw


@F.pandas_udf(StringType())
def pretty_json(x: pd.Series) -> pd.Series:
    """Two-space JSON with sorted keys; what isn't JSON is unchanged."""

    return x.map(_pretty)


@F.pandas_udf(ArrayType(StringType()))
def pretty_json_each(x: pd.Series) -> pd.Series:
    """pretty_json of each text of an array."""
    return x.map(lambda each: None if each is None else [_pretty(raw) for raw in each])


def jsonld_blocks(x: Column) -> Column:
    """Bodies of JSON-LD scripts: as two-space JSON, trimmed where they aren't JSON."""
    return pretty_json_each(F.transform(F.regexp_extract_all(through_last(x, "</script>"), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)), trim_space))


def numbered(blocks: Column, name: str) -> Column:
    """One block as it is; several under numbered headings."""
    shown = F.transform(blocks, lambda b, i: F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit("\n")), F.lit(f"### {name} "), (i + 1).cast("string"), F.lit("\n"), b))
    return F.when(F.size(blocks) == 1, F.element_at(blocks, 1)).otherwise(F.array_join(shown, "\n"))


def table_bodies(x: Column) -> Column:
    return F.regexp_extract_all(through_last(x, "</table>"), F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))


def every_row(body: Column) -> Column:
    """Array of all rows, each an array of (is_header, text); a row's plain cells before its last header cell are skipped."""

    def cells(row: Column) -> Column:
        row = through_last(row, "</t[hd]>")
        kinds = F.regexp_extract_all(row, F.lit(r"(?is)<(t[hd])[^>]*>.*?</t[hd]>"), F.lit(1))
        texts = F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1))
        every = F.transform(texts, lambda t, i: F.struct((F.lower(F.get(kinds, i)) == "th").alias("is_header"), trim_space(strip_tags(t)).alias("text")))
        last = F.size(kinds) - F.coalesce(F.array_position(F.reverse(F.transform(kinds, F.lower)), "th"), F.lit(0)) + F.when(F.array_contains(F.transform(kinds, F.lower), "th"), 0).otherwise(-F.size(kinds) - 1)
        return F.filter(every, lambda c, i: c["is_header"] | (i > last))

    return F.transform(F.regexp_extract_all(through_last(body, "</tr>"), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)


def table_rows(body: Column) -> Column:
    """The rows that have a cell."""
    return F.filter(every_row(body), lambda r: F.size(r) > 0)


def _markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: c["text"]), " | "), F.lit(" |"))


def table_markdown(body: Column) -> Column:
    """A table's Markdown, or null without cells.  The header is the first row that has a cell; data are the rows after the very first one, so a header behind an empty row is data too."""

    def shown(every: Column) -> Column:
        rows = F.filter(every, lambda r: F.size(r) > 0)
        first = F.try_element_at(rows, F.lit(1))
        rule = F.concat(F.lit("| "), F.array_join(F.transform(first, lambda c: F.lit("---")), " | "), F.lit(" |"))
        data = F.filter(every, lambda r, i: (i > 0) & (F.size(r) > 0))
        return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(_markdown_row(first), rule), F.transform(data, _markdown_row)), "\n"))

    return let(every_row(body), shown)


def tables_mode(x: Column) -> Column:
    found = F.filter(F.transform(table_bodies(x), table_markdown), lambda t: t.isNotNull())
    return F.when(F.size(found) == 0, F.lit(NO_TABLES)).otherwise(numbered(found, "Table"))
