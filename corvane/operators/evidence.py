"""Content hashes, citations and evidence bundles."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.batches import each_value
from corvane.functions.text import bytes_of
from corvane.operators.ordering import FEW_ROWS, RANGES, range_of, split_points

#: Most citations of a page, and bytes of context around a link's opening bracket.
MAX_CITATIONS, CONTEXT_BEFORE, CONTEXT_AFTER = 50, 40, 60
_BRACKET, _PAREN = re.compile(r"[\[\]]"), re.compile(r"\)")


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


#: Seconds of 400 years, after which the calendar repeats itself.
CYCLE = 146097 * 86400


def iso(epoch_seconds: Column) -> Column:
    """The instant in UTC sessions; years from 10000 on have more digits and no sign, and no timestamp's range is exceeded."""
    within = F.timestamp_seconds(F.pmod(epoch_seconds, F.lit(CYCLE)))
    year = F.year(within) + 400 * F.floor(epoch_seconds / CYCLE)
    return F.concat(F.format_string("%04d", year), F.date_format(within, "-MM-dd'T'HH:mm:ss'Z'"))


def link_matches(text: str) -> list[tuple[int, str, str]]:
    """(place, text, target) of Markdown links, in order of their opening brackets; brackets in the text are balanced.  Linear in the text."""
    opened: list[int] = []
    closed: dict[int, int] = {}
    for m in _BRACKET.finditer(text):
        if m.group() == "[":
            opened.append(m.start())
        elif opened:
            closed[opened.pop()] = m.start()
    ends = [m.start() for m in _PAREN.finditer(text)]
    out = []
    for start in sorted(closed):
        end = closed[start]
        if text[end + 1 : end + 2] == "(":
            at = bisect.bisect_left(ends, end + 2)
            if at < len(ends):
                out.append((start, text[start + 1 : end].strip(), text[end + 2 : ends[at]].strip()))
    return out


def _context(raw: bytes, at: int) -> str:
    """The first line of a window of bytes around a place, of whole characters."""
    a, b = max(0, at - CONTEXT_BEFORE), min(len(raw), at + CONTEXT_AFTER)
    while a < at and raw[a] & 0xC0 == 0x80:
        a += 1
    window = raw[a:b].decode(errors="ignore")
    return window.split("\n", 1)[0].strip()



_CITATION = T.StructType([T.StructField(x, T.StringType()) for x in ("text", "source_url", "context")])


_CITATIONS = pa.list_(pa.struct([(x, pa.string()) for x in _CITATION.names]))


def cited(text: str) -> list[dict]:
    """The citations of one text."""
    out, seen, raw, byte, last = [], set(), None, 0, 0
    for at, label, target in link_matches(text):
        if label and target.startswith(("http://", "https://")) and target not in seen:
            raw = text.encode() if raw is None else raw
            byte, last = byte + len(text[last:at].encode()), at
            seen.add(target)
            out.append({"text": label, "source_url": target, "context": _context(raw, byte)})
            if len(out) == MAX_CITATIONS:
                break
    return out


@F.arrow_udf(T.ArrayType(_CITATION))
def citations(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Array of (text, source_url, context): Markdown links to http(s), the first of each target, at most 50.

    Brackets inside a link's text may nest, which no regular expression follows.
    """
    return each_value(x, lambda v: cited(v.as_py()), _CITATIONS)


def bundle(content: Column, url: Column, strategy: Column, retrieved_at: Column, blocked: Column) -> Column:
    from corvane.functions.classify import confidence

    return F.struct(url.alias("url"), retrieved_at.alias("retrieved_at"), content_hash(content).alias("content_hash"), strategy.alias("strategy"), confidence(bytes_of(content), blocked).alias("confidence"), citations(content).alias("citations"))


def evidence_line(e: Column) -> Column:
    return F.concat(F.lit("📎 Evidence: sha256:"), F.left(e["content_hash"], F.lit(16)), F.lit("… | fetched "), e["retrieved_at"], F.lit(" | confidence: "), e["confidence"], F.lit(" | "), F.size(e["citations"]).cast("string"), F.lit(" citations"))


def latest(evidence: DataFrame) -> DataFrame:
    """The newest evidence of each url, by id."""
    columns = [c for c in evidence.columns if c != "url"]
    return evidence.groupBy("url").agg(F.max_by(F.struct(*columns), "id").alias("e")).select("url", "e.*")


def append(evidence: DataFrame, new: DataFrame, ranges: int = 4 * RANGES, few: int = FEW_ROWS) -> DataFrame:
    """The evidence (with ids) and after it new rows, numbered on in order of retrieval, url and hash (nulls first).

    Rows are numbered within about ``ranges`` ranges of equal numbers of rows, so rows of one day or
    instant are in many tasks (more than ``few`` rows, which are one range); only the ranges' counts are summed up in one place.
    """
    top = evidence.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    keyed = new.withColumn("_k", F.struct("retrieved_at", "url", "content_hash"))
    dealt = keyed.withColumn("_r", range_of(F.col("_k"), split_points(keyed.select("_k"), "_k", ranges, few)))
    # One row for each split point at most.
    counts = dealt.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_r").orderBy("_k"))
    numbered = dealt.join(F.broadcast(before), "_r").withColumn("id", (top + F.col("_before") + within).cast("long"))
    return evidence.unionByName(numbered.select(*evidence.columns))
