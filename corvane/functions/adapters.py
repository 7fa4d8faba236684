"""Site predicates, API addresses and parsers of search pages, site JSON and subtitles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import urls
from corvane.functions.html import strip_tags
from corvane.functions.text import let, lines, trim_space

#: Hosts of the sites with adapters.
REDDIT_HOSTS = ("reddit.com", "www.reddit.com", "old.reddit.com")
HN_HOSTS = ("news.ycombinator.com", "hackernews.com")
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "youtu.be", "m.youtube.com")
TOP_COMMENTS = 5


def site(url: Column) -> Column:
    """reddit, hn, video or null."""
    h = urls.host(url)
    return F.when(h.isin(*REDDIT_HOSTS), "reddit").when(h.isin(*HN_HOSTS), "hn").when(h.isin(*VIDEO_HOSTS), "video")


def api_url(url: Column) -> Column:
    """Address of the site's JSON, or null without one."""
    bare = F.regexp_replace(F.split_part(urls.path(url), F.lit("?"), F.lit(1)), "/+$", "")
    reddit = F.concat(F.lit("https://www.reddit.com"), bare, F.when(F.endswith(F.concat(F.lit("https://www.reddit.com"), bare), F.lit(".json")), "").otherwise(".json"), F.coalesce(F.concat(F.lit("?"), urls.query(url)), F.lit("")))
    item = F.nullif(F.regexp_extract(urls.query(url), r"(?:^|&)id=([^&]+)", 1), F.lit(""))
    hn = F.concat(F.lit("https://hacker-news.firebaseio.com/v0/item/"), item, F.lit(".json"))
    video = F.concat(F.lit("https://noembed.com/embed?url="), urls.encode_strict(url))
    s = site(url)
    return F.when(s == "reddit", reddit).when(s == "hn", hn).when(s == "video", video)


def _text(doc: Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(doc, path), F.lit(default))


_LISTING = "array<struct<data:struct<children:array<struct<data:struct<title:string,subreddit:string,author:string,score:bigint,selftext:string,body:string>>>>>>"


def reddit_markdown(doc: Column) -> Column:
    """Post and its first comments; null if the JSON can't be read."""
    listing = F.from_json(doc, _LISTING)
    post = F.try_element_at(F.try_element_at(listing, F.lit(1))["data"]["children"], F.lit(1))["data"]
    says = F.coalesce(post["selftext"], F.lit(""))
    head = F.concat(
        F.lit("# "), F.coalesce(post["title"], F.lit("(untitled)")), F.lit("\n\n**r/"), F.coalesce(post["subreddit"], F.lit("unknown")), F.lit("** · u/"),
        F.coalesce(post["author"], F.lit("[deleted]")), F.lit(" · ⬆ "), F.coalesce(post["score"], F.lit(0)).cast("string"), F.lit("\n\n"),
        F.when(says != "", F.concat(says, F.lit("\n\n"))).otherwise(""),
    )
    children = F.try_element_at(listing, F.lit(2))["data"]["children"]
    first = F.slice(F.filter(children, lambda c: c["data"].isNotNull()), 1, TOP_COMMENTS)

    def comment(c: Column) -> Column:
        d = c["data"]
        return F.concat(F.lit("**u/"), F.coalesce(d["author"], F.lit("[deleted]")), F.lit("** (⬆ "), F.coalesce(d["score"], F.lit(0)).cast("string"), F.lit(")\n\n"), F.coalesce(d["body"], F.lit("")), F.lit("\n\n---\n\n"))

    below = F.when(children.isNotNull(), F.concat(F.lit("---\n\n## Top Comments\n\n"), F.array_join(F.transform(first, comment), ""))).otherwise("")
    out = F.concat(F.when(post.isNotNull(), head).otherwise(""), below)
    return F.when(listing.isNotNull(), F.when(out == "", "(no content returned from Reddit API)\n").otherwise(out))


def hn_markdown(doc: Column) -> Column:
    text, link = F.get_json_object(doc, "$.text"), F.get_json_object(doc, "$.url")
    return F.concat(
        F.lit("# "), _text(doc, "$.title", "(untitled)"), F.lit("\n\n**Hacker News** · by "), _text(doc, "$.by", "[unknown]"), F.lit(" · ⬆ "), _text(doc, "$.score", "0"),
        F.lit(" · 💬 "), _text(doc, "$.descendants", "0"), F.lit("\n\n"), F.coalesce(F.concat(text, F.lit("\n\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("**Link:** ["), link, F.lit("]("), link, F.lit(")\n")), F.lit("")),
    )


def oembed_markdown(doc: Column) -> Column:
    picture, error = _text(doc, "$.thumbnail_url", ""), F.get_json_object(doc, "$.error")
    return F.concat(
        F.lit("# "), _text(doc, "$.title", "(untitled)"), F.lit("\n\n**Channel:** "), _text(doc, "$.author_name", "[unknown]"), F.lit("\n\n"),
        F.when(picture != "", F.concat(F.lit("![thumbnail]("), picture, F.lit(")\n\n"))).otherwise(""),
        F.coalesce(F.concat(F.lit("⚠ _"), error, F.lit("_\n")), F.lit("")),
    )


def site_markdown(url: Column, doc: Column) -> Column:
    s = site(url)
    return F.when(s == "reddit", reddit_markdown(doc)).when(s == "hn", hn_markdown(doc)).when(s == "video", oembed_markdown(doc))


def is_video_page(url: Column) -> Column:
    p = urls.path(url)
    return urls.host(url).isin(*VIDEO_HOSTS) & ((urls.host(url) == "youtu.be") | F.startswith(p, F.lit("/watch")) | F.startswith(p, F.lit("/embed/")))


def video_id(url: Column) -> Column:
    """First 11 characters of a well-formed video id, or null."""
    p = urls.path(url)
    short = F.split_part(F.regexp_replace(p, "^/+", ""), F.lit("?"), F.lit(1))
    watch = F.regexp_extract(F.split_part(p, F.lit("?"), F.lit(2)), r"(?:^|&)v=([^&]*)", 1)
    embed = F.split_part(F.regexp_replace(p, "^(/embed/)+", ""), F.lit("?"), F.lit(1))
    found = F.when(urls.host(url) == "youtu.be", short).when(F.startswith(p, F.lit("/watch")), watch).when(F.startswith(p, F.lit("/embed/")), embed)
    return F.when(F.rlike(found, F.lit(r"^[\p{L}\p{N}_-]{11,}\z")), F.left(found, F.lit(11)))


def vtt_cues(x: Column) -> Column:
    """Array of (ts, text) of a WebVTT file.

    A cue ends at the next blank, head or time line.  Text that comes without a time
    belongs to the next cue.  So a cue's lines are those from the end of the cue
    before it to its own end, and each line is looked at once.
    """

    def read(raw: Column) -> Column:
        def of(line: Column) -> Column:
            ends = (line == "") | F.rlike(line, F.lit("^(WEBVTT|Kind:|Language:)"))
            time = F.when(~ends & F.contains(line, F.lit("-->")), trim_space(F.split_part(line, F.lit("-->"), F.lit(1))))
            return F.struct((ends | time.isNotNull()).alias("edge"), F.coalesce(time, F.lit("")).alias("ts"), F.when(ends | time.isNotNull(), "").otherwise(strip_tags(line)).alias("text"))

        return let(trim_space(raw), of)

    def edges(rows: Column) -> Column:
        return F.filter(F.transform(rows, lambda r, i: F.struct(i.alias("at"), r["edge"].alias("edge"), r["ts"].alias("ts"))), lambda e: e["edge"])

    def timed(rows: Column, found: Column) -> Column:
        ended = F.transform(found, lambda e, k: F.struct(e["ts"].alias("ts"), F.coalesce(F.get(found, k + 1)["at"], F.size(rows)).alias("end")))
        return F.filter(ended, lambda c: c["ts"] != "")

    def cues(rows: Column, times: Column) -> Column:
        def cue(c: Column, k: Column) -> Column:
            first = F.coalesce(F.get(times, k - 1)["end"], F.lit(-1)) + 1
            said = F.filter(F.transform(F.slice(rows, first + 1, c["end"] - first), lambda r: r["text"]), lambda t: t != "")
            return F.struct(c["ts"].alias("ts"), trim_space(F.array_join(said, " ")).alias("text"))

        return F.filter(F.transform(times, cue), lambda c: c["text"] != "")

    return let(F.transform(lines(x), read), lambda rows: let(edges(rows), lambda found: let(timed(rows, found), lambda times: cues(rows, times))))


def srt_cues(x: Column) -> Column:
    """Array of (ts, text) of an SRT file; blocks of fewer than three lines are no cues."""
    blocks = F.filter(F.transform(F.split(x, "\n\n", -1), lines), lambda b: F.size(b) >= 3)

    def cue(b: Column) -> Column:
        said = F.filter(F.transform(F.slice(b, F.lit(3), F.size(b)), lambda x: strip_tags(trim_space(x))), lambda x: x != "")
        return F.struct(trim_space(F.split_part(trim_space(F.element_at(b, 2)), F.lit("-->"), F.lit(1))).alias("ts"), F.array_join(said, " ").alias("text"))

    return F.filter(F.transform(blocks, cue), lambda c: c["text"] != "")


def format_timestamp(ts: Column) -> Column:
    """[M:SS] or [H:MM:SS]; unchanged with fewer than three parts."""
    parts = F.split(ts, ":", -1)
    number = lambda i: F.coalesce(F.when(F.rlike(F.get(parts, F.lit(i)), F.lit(r"^\d{1,18}\z")), F.get(parts, F.lit(i)).cast("long")), F.lit(0))
    seconds = F.split_part(F.get(parts, F.lit(2)), F.lit("."), F.lit(1))
    long = F.concat(F.lit("["), number(0).cast("string"), F.lit(":"), F.lpad(number(1).cast("string"), 2, "0"), F.lit(":"), seconds, F.lit("]"))
    short = F.concat(F.lit("["), number(1).cast("string"), F.lit(":"), seconds, F.lit("]"))
    return F.when(F.size(parts) < 3, ts).when(number(0) > 0, long).otherwise(short)


def transcript_markdown(title: Column, seconds: Column, description: Column, cues: Column) -> Column:
    lasts = F.concat(F.lit("**Duration:** "), F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit("\n\n"))
    spoken = F.concat(F.lit("## Transcript\n\n"), F.array_join(F.transform(cues, lambda c: F.concat(F.lit("**"), format_timestamp(c["ts"]), F.lit("** "), c["text"], F.lit("\n\n"))), ""))
    silent = F.concat(F.lit("*No subtitles available.*\n\n"), F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("## Description\n\n"), description, F.lit("\n"))).otherwise(""))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce(lasts, F.lit("")), F.lit("---\n\n"), F.when(F.size(cues) == 0, silent).otherwise(spoken))


def search_results(html: Column, most: int) -> Column:
    """Array of (title, url) of a result page: each result's title, and the nearest link target before its mark; a result without one is left out."""
    mark = 'class="result__a"'

    def nearest(pieces: Column) -> Column:
        """For each piece the last one up to it that has a link, or -1: each such place, repeated until the next."""
        places = F.filter(F.transform(pieces, lambda p, i: F.when(F.contains(p, F.lit('href="')), i).otherwise(-1)), lambda i: i >= 0)

        def repeated(at: Column) -> Column:
            runs = F.flatten(F.transform(at, lambda i, k: F.array_repeat(i, F.coalesce(F.get(at, k + 1), F.size(pieces)) - i)))
            return F.concat(F.array_repeat(F.lit(-1), F.coalesce(F.get(at, F.lit(0)), F.size(pieces))), runs)

        return let(places, repeated)

    def results(pieces: Column, linked: Column) -> Column:
        def result(after: Column, i: Column) -> Column:
            plain = F.regexp_extract(after, r"(?s)^[^>]*>([^<]*)", 1)
            for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
                plain = F.replace(plain, F.lit(old), F.lit(new))
            # A link that isn't closed before the mark ends at the mark's own quote.
            source = F.concat(F.get(pieces, F.get(linked, i)), F.lit(mark))
            href = F.coalesce(F.regexp_extract(source, r'(?s)^.*href="([^"]*)"', 1), F.lit(""))
            return F.struct(trim_space(plain).alias("title"), urls.clean_result_url(href).alias("url"))

        return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), result)

    found = let(F.split(html, mark, -1), lambda pieces: let(nearest(pieces), lambda linked: results(pieces, linked)))
    return F.slice(F.filter(found, lambda r: F.startswith(r["url"], F.lit("http"))), 1, most)


def json_results(doc: Column, most: int) -> Column:
    """Array of (title, url, content) of a JSON result list; null if it can't be read or a field is missing."""
    found = F.from_json(doc, "struct<results:array<struct<title:string,url:string,content:string>>>")["results"]
    whole = F.forall(found, lambda r: r["title"].isNotNull() & r["url"].isNotNull() & r["content"].isNotNull())
    return F.when(whole, F.slice(found, 1, most))
