"""Sections of Markdown, focus scores and structural profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import SPACE, bytes_of, let, lines

STRUCTURAL_SHARE = 0.5


def keywords(focus: Column) -> Column:
    """Lower-cased words without other characters at their ends."""
    words = F.transform(F.split(F.lower(focus), f"{SPACE}+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(words, lambda w: w != "")


def parse_sections(x: Column) -> Column:
    """Array of (heading, content, level): lines are looked at once, then cut between headings, so work is linear in the text."""

    def level(line: Column) -> Column:
        return F.length(F.regexp_extract(line, f"^{SPACE}*(#*)", 1))

    def cut(both: Column) -> Column:
        all_lines, heads = both["lines"], both["heads"]

        def section(k: Column) -> Column:
            start = F.coalesce(F.get(heads, k - 1), F.lit(-1))
            end = F.coalesce(F.get(heads, k), F.size(all_lines))
            line = F.get(all_lines, start)
            heading = F.regexp_replace(F.coalesce(line, F.lit("")), f"^{SPACE}*#*{SPACE}*|{SPACE}+\\z", "")
            # A body's leading blank lines vanish.
            content = F.regexp_replace(F.array_join(F.slice(all_lines, start + 2, end - start - 1), "\n"), "^\n+", "")
            return F.struct(heading.alias("heading"), content.alias("content"), F.when(k == 0, 0).otherwise(level(line)).cast("tinyint").alias("level"))

        every = F.transform(F.sequence(F.lit(0), F.size(heads)), section)
        return F.filter(every, lambda s: (s["heading"] != "") | (s["content"] != ""))

    def with_heads(all_lines: Column) -> Column:
        numbered = F.transform(all_lines, lambda line, i: F.when(level(line).between(1, 6), i))
        return F.struct(all_lines.alias("lines"), F.filter(numbered, lambda i: i.isNotNull()).alias("heads"))

    return let(let(lines(x), with_heads), cut)


def explode_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_idx, heading, content, level."""
    return docs.select(key, F.posexplode(parse_sections(F.col(text))).alias("section_idx", "s")).select(key, "section_idx", "s.heading", "s.content", "s.level")


def relevance(heading: Column, content: Column, words: Column) -> Column:
    """Share of keywords found, half the share in the heading, and a tenth of the body's log size."""
    total = F.size(words)
    both, head = F.lower(F.concat(heading, F.lit(" "), content)), F.lower(heading)
    found = F.size(F.filter(words, lambda w: F.contains(both, w)))
    in_head = F.size(F.filter(words, lambda w: F.contains(head, w)))
    size = F.when(bytes_of(content) > 0, F.greatest(F.log2(bytes_of(content).cast("double")), F.lit(0.0))).otherwise(0.0)
    return F.when(total == 0, 0.0).otherwise(found / total + 0.5 * in_head / total + size / 10)


def rank_sections(sections: DataFrame, key: str, focus: str) -> DataFrame:
    """Sections with score, keyword hits, and rank within the document (by score, then order)."""
    words = keywords(F.lit(focus))
    both = F.lower(F.concat("heading", F.lit(" "), "content"))
    scored = sections.withColumns({"score": relevance(F.col("heading"), F.col("content"), words), "hits": F.size(F.filter(words, lambda w: F.contains(both, w)))})
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "section_idx")))


def focused_text(x: Column, focus: str) -> Column:
    """The text's sections with a positive score, best first; the whole text if there is none."""
    words = keywords(F.lit(focus))
    scored = F.transform(parse_sections(x), lambda s, i: F.struct((-relevance(s["heading"], s["content"], words)).alias("order"), i.alias("i"), s["heading"].alias("heading"), s["content"].alias("content")))

    def shown(kept: Column) -> Column:
        each = F.transform(kept, lambda s: F.when(s["heading"] == "", s["content"]).otherwise(F.concat(s["heading"], F.lit("\n"), s["content"])))
        return F.when(F.size(kept) == 0, x).otherwise(F.array_join(each, "\n\n"))

    return let(F.array_sort(F.filter(scored, lambda s: s["order"] < 0)), shown)


def domain_profile(sections: DataFrame, domain: str, page: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages a domain, counts a heading, counts a level)."""
    pages = sections.groupBy(domain).agg(F.countDistinct(page).alias("pages"))
    headed = sections.where("heading <> ''").withColumn("heading", F.lower("heading"))
    return pages, headed.groupBy(domain, "heading").agg(F.count(F.lit(1)).alias("n")), headed.groupBy(domain, "level").agg(F.count(F.lit(1)).alias("n"))


def structural_headings(pages: DataFrame, headings: DataFrame, domain: str) -> DataFrame:
    """Headings that occur on at least half of a domain's pages, with their ratio."""
    return headings.join(pages, domain).withColumn("ratio", F.col("n") / F.col("pages")).where(F.col("ratio") >= STRUCTURAL_SHARE)


def adjust_scores(sections: DataFrame, structural: DataFrame, domain: str) -> DataFrame:
    """Scores lowered by the ratio of structural headings; it may exceed 1 and turn a score negative."""
    marks = structural.select(F.col(domain).alias("_domain"), F.col("heading").alias("_heading"), "ratio")
    same = (F.col(domain) == F.col("_domain")) & (F.lower("heading") == F.col("_heading"))
    return sections.join(marks, same, "left").withColumn("adjusted", F.col("score") * (1 - F.coalesce("ratio", F.lit(0.0))) + F.lit(0.0)).drop("_domain", "_heading", "ratio")


def dominant_level(levels: DataFrame, domain: str) -> DataFrame:
    """The most frequent heading level; of equal counts the smallest."""
    return levels.groupBy(domain).agg(F.max_by("level", F.struct("n", (-F.col("level").cast("int")).alias("o"))).alias("level"))
