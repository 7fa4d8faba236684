"""Extraction over pages: content-type dispatch, modes, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import markdown, tokens
from corvane.functions.text import let
from corvane.functions.urls import title_from_url
from corvane.operators import readability

#: Content types that have no text.
BINARY_TYPES = ("application/pdf", "application/octet-stream", "image/", "video/", "audio/")
MODES = ("markdown", "text", "html", "links", "metadata", "json-ld", "tables")
SEPARATOR = "\n\n---\n\n"
#: Items of a batch.
MOST_IN_BATCH = 10


def parse_mode(mode: Column) -> Column:
    """Known modes by any case; json-ld names and unknown ones are resolved."""
    low = F.lower(mode)
    return F.when(low == "jsonld", "json-ld").when(low.isin(*MODES), low).otherwise("markdown")


def content_kind(content_type: Column) -> Column:
    """json, plain, binary or html; the first match wins."""
    low = F.lower(content_type)
    binary = F.lit(False)
    for t in BINARY_TYPES:
        binary = binary | F.contains(low, F.lit(t))
    return F.when(F.contains(low, F.lit("application/json")), "json").when(F.contains(low, F.lit("text/plain")), "plain").when(binary, "binary").otherwise("html")


def unsupported(content_type: Column) -> Column:
    return F.concat(F.lit("[Unsupported content type: "), content_type, F.lit(". Binary content cannot be extracted.]"))


def dispatch(pages: DataFrame) -> DataFrame:
    """pages (url, html, content_type) with kind, title, text_content and length; HTML goes through the readability extractor."""
    kind, body = content_kind(F.col("content_type")), F.col("html")
    marked = readability.main_content(pages.withColumn("kind", kind), "html", when="kind = 'html'")
    text = F.when(F.col("kind") == "json", H.pretty_json(body)).when(F.col("kind") == "plain", body).when(F.col("kind") == "binary", unsupported(F.col("content_type"))).otherwise(markdown.clean(F.col("main_text")))
    title = F.when(F.col("kind") == "binary", "").when(F.col("kind") == "html", F.coalesce(F.col("main_title"), F.lit(""))).otherwise(title_from_url(F.col("url")))
    length = F.when(F.col("kind") == "binary", 0).when((F.col("kind") == "html") & body.isNotNull(), F.length(text)).otherwise(F.octet_length(body)).cast("long")
    return marked.withColumns({"title": title, "text_content": F.when((F.col("kind") != "html") | (F.col("main_text") != ""), text), "length": length}).drop("main_text", "main_title")


def extract(body: Column, url: Column, mode: str) -> Column:
    """Text of a page in one of the modes but markdown, as a column expression."""
    if mode == "text":
        return H.text_mode(body)
    if mode == "html":
        return H.html_mode(body)
    if mode == "links":
        return H.links_mode(body)
    if mode == "metadata":
        return H.metadata_mode(body)
    if mode == "tables":
        return H.tables_mode(body)
    if mode == "json-ld":
        blocks = H.jsonld_blocks(body)
        return F.when(F.size(blocks) == 0, F.lit(H.NO_JSONLD)).otherwise(H.numbered(blocks, "Structured Data Block"))
    raise ValueError(f"no column expression for mode {mode}")


def item_text(text: Column, url: Column, warning: Column, error: Column, exhausted: Column, budget: Column, label: str = "corvane") -> Column:
    """What a batch shows of one address: its text with a quality warning, within the budget; or its error."""
    why = F.when(exhausted, F.concat(F.lit("all strategies exhausted: "), error)).otherwise(error)
    warned = F.concat(F.coalesce(text, F.lit("")), F.coalesce(F.concat(F.lit(f"\n\n[{label}: "), warning, F.lit("]")), F.lit("")))
    return F.when(error.isNotNull(), F.concat(F.lit("[fetch error for "), url, F.lit(": "), why, F.lit("]"))).otherwise(let(warned, lambda whole: tokens.apply_budget(whole, budget)))


def combine(items: DataFrame, group: str = "batch", position: str = "pos", text: str = "text", most: int = MOST_IN_BATCH) -> DataFrame:
    """One text a group, its items in order of position, and null with an error for a group of more than ``most`` items.

    Of each group only the first items and one more leave their partitions, so a group
    of any size is told apart from a whole one without being gathered.
    """
    order = Window.partitionBy(group).orderBy(position, text)
    first = items.select(group, position, text).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most + 1)
    gathered = F.array_sort(F.collect_list(F.struct("_k", F.coalesce(text, F.lit("")).alias("text"))))
    joined = first.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), gathered.alias("_t"))
    return joined.select(group, F.when(F.col("_n") <= most, F.array_join("_t.text", SEPARATOR)).alias("combined"), F.when(F.col("_n") > most, F.lit(f"Maximum {most} URLs per batch")).alias("error"))
