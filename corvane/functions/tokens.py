"""Token estimates and budgets (T1-T7).  A token counts as four bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import SPACE, byte_prefix, bytes_of, let, lines

#: Marks of cut texts.
BUDGET_MARK = "\n\n[... truncated to fit token budget]"
SECTION_MARK = "\n\n[... truncated ...]"
PREVIEW_MARK = " [...]"
TOC_TITLE = "## Table of Contents"


def estimate(x: Column) -> Column:
    return F.floor(bytes_of(x) / 4).cast("long")


def apply_budget(x: Column, budget: Column) -> Column:
    """Cut at the budget with a mark; a null or zero budget is unlimited."""
    limit = budget * 4
    return F.when(budget.isNull() | (budget == 0) | (bytes_of(x) <= limit), x).otherwise(F.concat(byte_prefix(x, limit), F.lit(BUDGET_MARK)))


def preview(x: Column, n: int) -> Column:
    return F.when(bytes_of(x) > n, F.concat(byte_prefix(x, n), F.lit(PREVIEW_MARK))).otherwise(x)


def truncate_to_budget(x: Column, budget: Column) -> Column:
    """(text, truncated), cut at the last paragraph, else sentence, else word within the budget."""
    limit = budget * 4
    head = byte_prefix(x, limit)
    cuts = [(r"(?s)^(.*)\n\n", "\n\n"), (r"(?s)^(.*\.) ", ". "), (r"(?s)^(.*) ", " ")]
    cut = head
    for pattern, mark in reversed(cuts):
        cut = F.when(F.contains(head, F.lit(mark)), F.regexp_extract(head, pattern, 1)).otherwise(cut)
    fits = bytes_of(x) <= limit
    return F.struct(F.when(fits, x).otherwise(cut).alias("text"), (~fits).alias("truncated"))


def split_sections(x: Column) -> Column:
    """At second-level headings if there are any, else at blank lines."""
    headed = F.filter(F.split(x, r"\n(?=## )", -1), lambda s: s != "")
    return F.when(F.contains(x, F.lit("\n## ")), headed).otherwise(F.split(x, "\n\n", -1))


def truncate_sections(x: Column, budget: Column) -> Column:
    """Sections in order as long as they fit, skipping those that don't; with a mark if any is missing."""
    limit, mark = budget * 4, len(SECTION_MARK)
    usable = F.greatest(limit - mark, F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("long").alias("held"))

    def take(state: Column, s: Column) -> Column:
        need = state["held"] + bytes_of(s) + F.when(F.size(state["kept"]) == 0, 0).otherwise(2)
        return F.when(need <= usable, F.struct(F.array_append(state["kept"], s).alias("kept"), need.alias("held"))).otherwise(state)

    single = F.concat(F.regexp_replace(byte_prefix(x, usable), f"{SPACE}+\\z", ""), F.lit(SECTION_MARK))

    def several(sections: Column) -> Column:
        marked = lambda joined: F.when(bytes_of(joined) < bytes_of(x), F.concat(joined, F.lit(SECTION_MARK))).otherwise(joined)
        # What is kept is bounded by the budget, so the fold is linear in the text.
        return F.when(F.size(sections) <= 1, single).otherwise(let(F.array_join(F.aggregate(sections, start, take)["kept"], "\n\n"), marked))

    return F.when(bytes_of(x) <= limit, x).otherwise(let(split_sections(x), several))


def truncate_smart(x: Column, budget: Column) -> Column:
    """(text, truncated): whole lines up to the first heading past the budget, under a list of all headings.

    Lines are looked at once; the fold that finds the cut runs over their sizes alone.
    """
    limit = (budget * 4).cast("long")
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("held"), zero.alias("broke"), F.lit(False).alias("done"))

    def step(s: Column, line: Column) -> Column:
        stop = s["done"] | ((s["held"] + line["size"] + 1 > limit) & line["head"] & (s["held"] > 0))
        held = s["held"] + line["size"] + F.when(s["held"] > 0, 1).otherwise(0)
        grown = F.struct((s["n"] + 1).alias("n"), held.alias("held"), F.when(line["head"], held).otherwise(s["broke"]).alias("broke"), F.lit(False).alias("done"))
        return F.when(stop, F.struct(s["n"].alias("n"), s["held"].alias("held"), s["broke"].alias("broke"), F.lit(True).alias("done"))).otherwise(grown)

    def cut(both: Column) -> Column:
        end, all_lines = both["end"], both["lines"]
        # Leading empty lines are lost, as nothing is held yet.
        taken = F.regexp_replace(F.array_join(F.slice(all_lines, F.lit(1), end["n"].cast("int")), "\n"), "^\n+", "")
        body = let(taken, lambda t: F.when((bytes_of(t) > limit * 2) & (end["broke"] > 0), byte_prefix(t, end["broke"])).otherwise(t))
        headings = F.transform(F.filter(all_lines, _is_heading), lambda h: F.concat(F.lit("- "), F.regexp_replace(h, f"^{SPACE}*#*{SPACE}*|{SPACE}+\\z", "")))
        return F.when(F.size(headings) > 0, F.concat(F.lit(f"{TOC_TITLE}\n"), F.array_join(headings, "\n"), F.lit("\n\n"), body)).otherwise(body)

    def folded(all_lines: Column) -> Column:
        sized = F.transform(all_lines, lambda line: F.struct(bytes_of(line).alias("size"), _is_heading(line).alias("head")))
        return F.struct(all_lines.alias("lines"), F.aggregate(sized, start, step).alias("end"))

    fits = bytes_of(x) <= limit
    return F.struct(F.when(fits, x).otherwise(let(let(lines(x), folded), cut)).alias("text"), (~fits).alias("truncated"))


def _is_heading(line: Column) -> Column:
    return F.rlike(line, F.lit(f"^{SPACE}*#"))


def diagnostics(strategy: Column, cache_hit: Column, spa: Column, js_rendered: Column, text: Column, mode: Column, latency_ms: Column, budget: Column, block: Column) -> Column:
    """The diagnostics of a fetch as one struct."""
    return F.struct(
        strategy.alias("strategy_used"),
        cache_hit.alias("cache_hit"),
        spa.alias("spa_detected"),
        js_rendered.alias("js_rendered"),
        F.lit(0).alias("redirect_count"),
        bytes_of(text).alias("content_length"),
        F.size(lines(text)).cast("long").alias("line_count"),
        estimate(text).alias("token_count"),
        budget.cast("long").alias("token_budget"),
        F.when(cache_hit, "high").when(js_rendered, "medium").otherwise("high").alias("confidence"),
        mode.alias("extraction_mode"),
        latency_ms.cast("long").alias("fetch_latency_ms"),
        block.alias("block_detected"),
    )


def diagnostics_line(strategy: Column, latency_ms: Column, cache_hit: Column, mode: Column, n_bytes: Column, spa: Column, block: Column) -> Column:
    """One line on a fetch."""
    return F.concat_ws(
        ", ",
        strategy,
        F.concat(latency_ms.cast("string"), F.lit("ms")),
        F.when(cache_hit, "cache HIT").otherwise("cache MISS"),
        mode,
        F.concat(n_bytes.cast("string"), F.lit(" chars")),
        F.when(spa, "SPA detected"),
        F.when(block.isNotNull(), F.concat(F.lit("blocked:"), block)),
    )
