"""Operators on small cases with known results."""

import json
import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import adapters, batches, classify, html, markdown, text, tokens, urls
from corvane.operators import boilerplate, cache, evidence, extraction, history, readability, robots, routes, sections
from corvane.plans import catalog
from corvane.sources import config, route_files, seeds


def value(spark, column, *given, names=("x", "y", "z")):
    df = spark.createDataFrame([tuple(given)], ", ".join(f"{n} {'string' if isinstance(g, (str, type(None))) else 'bigint'}" for n, g in zip(names, given, strict=False)))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("a\r\nb\r\n", ["a", "b"]), ("a\rb", ["a\rb"])],
)
def test_lines(spark, given, want):
    assert value(spark, text.lines(F.col("x")), given) == want


@pytest.mark.parametrize("given", ["abc", "aé漢🙂z", "🙂🙂", "é" * 9, ""])
def test_byte_prefix(spark, given):
    for n in range(12):
        assert value(spark, text.byte_prefix(F.col("x"), n), given) == given.encode()[:n].decode(errors="ignore")


@pytest.mark.parametrize(
    ("url", "domain", "host", "path", "query"),
    [
        ("https://A.example:80/p?q=1", "A.example", "a.example", "/p?q=1", "q=1"),
        ("http://a.example?x", "a.example?x", "a.example?x", "/", None),
        ("ftp://a.example/", None, "ftp", "//a.example/", None),
        ("https:///x", None, "", "/x", None),
    ],
)
def test_urls(spark, url, domain, host, path, query):
    got = [value(spark, f(F.col("x")), url) for f in (urls.domain, urls.host, urls.path, urls.query)]
    assert got == [domain, host, path, query]


def test_result_urls(spark):
    assert value(spark, urls.clean_result_url(F.col("x")), "//r/?uddg=https%3A%2F%2Fa.example%2Fb+c&rut=1") == "https://a.example/b c"
    assert value(spark, urls.clean_result_url(F.col("x")), "//r/?uddg=%zz") == "%zz"
    assert value(spark, urls.clean_result_url(F.col("x")), "//a.example") == "https://a.example"


def test_html_modes(spark):
    page = '<html><head><title> T &amp; é </title><style>s</style></head><body><nav>n</nav><NAVX>k</NAVX>Hello <!-- c --> <b>w   x</b><script>if (a<b) {}</script> 5 > 4 <a href="/u">L</a><a href=\'#f\'>no</a><a data-href="q">d</a>'
    assert value(spark, html.title(F.col("x")), page) == "T &amp; é"
    assert value(spark, html.text_mode(F.col("x")), page) == "T &amp; é nkHello w x 5 4 Lnod"
    assert value(spark, html.html_mode(F.col("x")), "<nav>a</nav><p>b</p><svg><!-- x") == "<p>b</p>"
    assert value(spark, html.text_mode(F.col("x")), "<script>only</script>") is None
    assert [tuple(a) for a in value(spark, html.anchors(F.col("x")), page)] == [("L", "/u"), ("d", "q")]


def test_table_cells_before_a_header_cell_are_skipped(spark):
    rows = value(spark, html.table_rows(F.col("x")), "<tr><td>a</td><th>b</th><td>c</td></tr><tr><td>d</td><td>e</td></tr>")
    assert [[(c["is_header"], c["text"]) for c in r] for r in rows] == [[(True, "b"), (False, "c")], [(False, "d"), (False, "e")]]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", "| a |\n| --- |\n| b |"),
        ("<table><tr><th>h</th></tr><tr><td>a</td></tr><tr></tr></table>", "| h |\n| --- |\n| a |"),
        ("<table><tr></tr><tr><td>a</td></tr></table>", "| a |\n| --- |\n| a |"),
        ("<table><tr></tr><tr><th>h</th></tr><tr><td>a</td></tr></table>", "| h |\n| --- |\n| h |\n| a |"),
        ("<table><tr></tr></table>", html.NO_TABLES),
    ],
)
def test_tables(spark, given, want):
    assert value(spark, html.tables_mode(F.col("x")), given) == want


def test_jsonld_is_shown_as_json(spark):
    page = '<script type="application/ld+json"> {"b":[1,2],"a":NaN} </script><script type="application/ld+json">{"b":[],"a":1}</script>'
    assert value(spark, html.jsonld_blocks(F.col("x")), page) == ['{"b":[1,2],"a":NaN}', '{\n  "a": 1,\n  "b": []\n}']


def test_any_mount_point_counts(spark):
    for mount in ('<div id="x">', "<div id='x'>", "<div id=x>"):
        assert value(spark, classify.spa_framework(F.col("x")), f"<body>{mount}</div></body>") == "GenericSpa"


def test_a_script_page_on_the_last_attempt_ends_exhausted(spark):
    outcomes = spark.createDataFrame([("u", s, None if s == "TlsMobile" else "Blocking", s == "TlsMobile", False) for s in routes.STRATEGIES], "url string, strategy string, error_class string, is_spa boolean, valuable boolean")
    row = routes.replay(spark.createDataFrame([("u", "HttpSimple")], "url string, strategy string"), outcomes).first()
    assert (row["strategy"], row["attempts"], row["result"], row["visited"]) == ("TlsMobile", 3, "exhausted", "HttpSimple,TlsChrome,TlsMobile")


def test_long_documents_take_linear_time(spark):
    lines = "".join(f"## head {i}\n" if i % 10 == 0 else f"line {i} of a long text\n" for i in range(100_000))
    began = time.time()
    assert value(spark, F.size(sections.parse_sections(F.col("x"))), lines) == 10_000
    got = value(spark, tokens.truncate_smart(F.col("x"), F.lit(1000)), lines)
    assert got["truncated"] and got["text"].count("- head") == 10_000
    assert value(spark, tokens.truncate_sections(F.col("x"), F.lit(1000)), lines).endswith(tokens.SECTION_MARK)
    old = lines.replace("line 7", "row 7")
    assert value(spark, history.diff(F.col("x"), F.col("y")), lines, old)["added_lines"] == 10_000
    docs = spark.createDataFrame([("d", 1, lines + "menu\nmenu\nmenu")], "domain string, id bigint, text string")
    marks = boilerplate.boilerplate(boilerplate.block_counts(boilerplate.exploded(docs, "domain", "id", "text"), "domain"))
    assert boilerplate.strip(docs, marks, "domain", "id", "text").first()["text"] == lines.rstrip("\n")
    assert time.time() - began < 60


def test_markdown(spark):
    cases = {r"\-a \* b": r"-a \* b", "##x\n#\n####### y": "## x\n#\n####### y", "[t]() [u](v)": "t [u](v)", "a\n\n\n\n\nb": "a\n\n\nb", "  a  ": "a"}
    for given, want in cases.items():
        assert value(spark, markdown.clean(F.col("x")), given) == want
        assert value(spark, markdown.clean(F.col("x")), want) == want


def test_quality(spark):
    good = "\n".join(["A line with enough words to count as content here."] * 5)
    assert value(spark, classify.quality_reason(F.col("x")), good) is None
    assert value(spark, classify.quality_reason(F.col("x")), good + "<HEADER>") == classify.ARTIFACT
    assert value(spark, classify.quality_reason(F.col("x")), "short") == classify.SHORT
    assert value(spark, classify.quality_reason(F.col("x")), "x" * 300 + "\n\n \n") == classify.FEW_LINES


def test_truncation(spark):
    assert value(spark, tokens.estimate(F.col("x")), "aé") == 0
    assert value(spark, tokens.apply_budget(F.col("x"), F.col("y")), "é" * 10, 1) == "éé" + tokens.BUDGET_MARK
    assert value(spark, tokens.apply_budget(F.col("x"), F.col("y")), "abcdef", 0) == "abcdef"
    cut = lambda s, n: tuple(value(spark, tokens.truncate_to_budget(F.col("x"), F.col("y")), s, n))
    assert cut("one two. three four", 3) == ("one two.", True)
    assert cut("para\n\nmore. text here", 4) == ("para", True)
    assert cut("onetwothreefour", 2) == ("onetwoth", True)
    assert cut("short", 2) == ("short", False)
    doc = "intro\n## A\n" + "a" * 40 + "\n## B\nb\n## C\nc"
    assert value(spark, tokens.truncate_sections(F.col("x"), F.lit(12)), doc) == "intro\n\n## B\nb\n\n## C\nc" + tokens.SECTION_MARK
    smart = value(spark, tokens.truncate_smart(F.col("x"), F.lit(3)), "# A\nbody text\n# B\nmore")
    assert tuple(smart) == ("## Table of Contents\n- A\n- B\n\n# A\nbody text", True)
    assert tuple(value(spark, tokens.truncate_smart(F.col("x"), F.lit(1)), "no heading at all")) == ("no heading at all", True)


def test_sections(spark):
    got = value(spark, sections.parse_sections(F.col("x")), "lead\n\n# A\n\n\nbody\n\n##B \n####### seven\n#\n# \nlast")
    assert [(s["heading"], s["content"], s["level"]) for s in got] == [("", "lead\n", 0), ("A", "body\n", 1), ("B", "####### seven", 2), ("", "last", 1)]
    assert value(spark, sections.keywords(F.col("x")), ' The "Doc", -- über! ') == ["the", "doc", "über"]
    assert value(spark, sections.focused_text(F.col("x"), "zebra"), "# A\nlonger text\n# Zebra\nzebra here") == "Zebra\nzebra here\n\nA\nlonger text"
    assert value(spark, sections.parse_sections(F.col("x")), "") == []


def test_boilerplate(spark):
    docs = spark.createDataFrame([("d", 1, "menu\n text one\n\nmenu"), ("d", 2, "menu\nother"), ("e", 3, "menu"), ("e", 4, "")], "domain string, id bigint, text string")
    rows = boilerplate.exploded(docs, "domain", "id", "text")
    marks = boilerplate.boilerplate(boilerplate.block_counts(rows, "domain"))
    assert [r["n"] for r in marks.collect()] == [3]
    assert {r["id"]: r["text"] for r in boilerplate.strip(docs, marks, "domain", "id", "text").collect()} == {1: " text one\n", 2: "other", 3: "menu"}


def test_robots(spark):
    file = "User-agent: *\nDisallow: /private\nAllow: /private/ok\n\nUser-agent: me\nDisallow: /*.pdf\n"
    allowed = lambda agent, path: value(spark, robots.is_allowed(F.col("y"), robots.parse_rules(F.col("x"), agent)), file, path)
    assert [allowed("you", p) for p in ("/", "/private/x", "/private/ok/1")] == [True, False, True]
    assert [allowed("ME", p) for p in ("/private/x", "/a/b.pdfx", "/a")] == [True, False, True]


LOG = "event_id bigint, ts timestamp_ntz, domain string, strategy string, latency_ms bigint, success boolean"


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, ts string, domain string, strategy string, latency_ms bigint, success boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_routes(spark):
    log = log_rows(spark, [(1, "2024-01-01", "d", "HttpSimple", 200, True), (2, "2024-01-02", "d", "HttpSimple", 401, False), (3, "2024-01-01", "d", "TlsChrome", 3000, True)])
    stats = routes.route_stats(log)
    row = stats.where("strategy = 'HttpSimple'").first()
    assert (row["avg_latency_ms"], row["success_rate"], row["total_requests"]) == (300, 0.5, 2)
    assert row["last_success_at"].day == 1 and row["last_check_at"].day == 2
    assert routes.best(stats).first()["strategy"] == "HttpSimple"
    order = log_rows(spark, [(i, f"2024-01-0{i}", "d", "Headless", x, True) for i, x in enumerate((100, 201, 300), 1)])
    assert routes.route_stats(order).first()["avg_latency_ms"] == 200
    merged = routes.merge_outcomes(routes.route_stats(order.where("event_id < 3")), order.where("event_id = 3")).first()
    assert (merged["avg_latency_ms"], merged["total_requests"]) == (200, 3)
    urls_ = spark.createDataFrame([("d",), ("none",)], "domain string")
    assert {r["domain"]: (r["known"], r["strategy"]) for r in routes.resolve(urls_, stats).collect()} == {"d": (True, "HttpSimple"), "none": (False, "HttpSimple")}


def test_route_files(spark, tmp_path):
    stats = routes.route_stats(seeds.seed_log(spark))
    assert stats.count() == 57 and seeds.import_seeds(stats).count() == 57
    route_files.export_json(stats, str(tmp_path / "routes"))
    assert route_files.read_entries(spark, str(tmp_path / "routes"), lines=True).count() == 57
    (tmp_path / "routes.json").write_text(route_files.export_text(stats).first()["json"])
    assert len(json.loads((tmp_path / "routes.json").read_text())) == route_files.read_entries(spark, str(tmp_path / "routes.json")).count() == 57
    (tmp_path / "pack.json").write_text(json.dumps({"name": "p", "version": "1", "domains": [{"domain": "x.example", "strategy": "Headless"}]}))
    pack = routes.route_stats(route_files.read_pack(spark, str(tmp_path / "pack.json"), F.lit("2024-01-01").cast("timestamp_ntz"))).first()
    assert (pack["domain"], pack["avg_latency_ms"], pack["success_rate"]) == ("x.example", 0, 1.0)
    for version in (1, 2):
        route_files.save_store({"routes": stats.limit(version)}, str(tmp_path / "store"), version)
    assert route_files.load_store(spark, str(tmp_path / "store"), "routes").count() == 2
    zipped = spark.createDataFrame([("aé" * 50,)], "x string").select(route_files.gunzip_text(route_files.gzip_bytes("x")).alias("y"))
    assert zipped.first()["y"] == "aé" * 50


CACHE = "url string, strategy string, extraction_mode string, content_hash string, content string, content_type string, original_size bigint, created_at timestamp_ntz, last_accessed_at timestamp_ntz, expires_at timestamp_ntz, etag string, last_modified string"


def entries(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("https://a.example/"), F.col("id").cast("string")).alias("url"), F.lit("HttpSimple").alias("strategy"), F.lit("markdown").alias("extraction_mode"), F.repeat(F.lit("x"), (F.col("id") + 1).cast("int")).alias("content"), F.lit("t").alias("content_type"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("created_at"))
    return cache.put(spark.createDataFrame([], CACHE), rows, 3600)


def test_cache(spark):
    c = entries(spark, 10)
    assert c.count() == 10 and c.columns == [x.split()[0] for x in CACHE.split(", ")]
    kept = cache.evict_lru(c, 27, buckets=3)
    sizes = [r["original_size"] for r in kept.orderBy("last_accessed_at").collect()]
    assert sizes == [8, 9, 10] and cache.evict_lru(c, 1000).count() == 10
    now = F.lit("2024-01-01 05:30:00").cast("timestamp_ntz")
    assert cache.drop_expired(c, now).count() == 5
    assert cache.delete(c, url="https://a.example/3").count() == 9 and cache.clear(c).count() == 0
    with pytest.raises(ValueError):
        cache.delete(c)
    big = c.select("url", "strategy", "extraction_mode", F.repeat(F.lit("y"), F.lit(102_401)).alias("content"), "content_type", "created_at")
    assert cache.put(c, big, 10).where("original_size > 100").count() == 0


def test_cache_reports(spark):
    tops = F.array(F.struct(F.lit("a").alias("domain"), F.lit(2).cast("bigint").alias("n")))
    got = value(spark, cache.stats_text(F.lit(2), F.lit(1536), F.lit("o"), F.lit(None).cast("string"), tops), "x")
    assert got == "**Entries:** 2\n**Total size:** 1536 bytes (1.5 KB)\n**Oldest:** o\n\n**Top domains:**\n- a (2 entries)\n"


def test_evidence(spark):
    got = value(spark, evidence.citations(F.col("x")), "[a](https://x) [ ](https://y) [b](/rel) [c](https://x) [d]( http://z )")
    assert [(c["text"], c["source_url"]) for c in got] == [("a", "https://x"), ("d", "http://z")]
    got = value(spark, evidence.citations(F.col("x")), "é" * 30 + "\n ab [see [1] here](https://x) [open [in](https://y) ](https://q) [z](https://w")
    assert [(c["text"], c["source_url"]) for c in got] == [("see [1] here", "https://x"), ("open [in](https://y)", "https://q"), ("in", "https://y")]
    # The brackets are at bytes 65, 91 and 97; of the first line whole letters of two bytes are left from 40 bytes before, up to byte 60.
    assert [c["context"] for c in got] == ["é" * 17, "é" * 4, "é"]
    assert evidence.link_matches("[" * 200_000 + "]" * 200_000 + "(u)")[0][0] == 0
    assert value(spark, evidence.iso(F.col("x")), 1709251200) == "2024-03-01T00:00:00Z"


def test_diff(spark):
    got = value(spark, history.diff(F.col("x"), F.col("y")), "a\nb\nb\nnew", "a\nold\n")
    assert tuple(got) == (3, 1, 1, 25.0, "+ b\n+ b\n+ new\n- old\n")
    assert tuple(value(spark, history.diff(F.col("x"), F.col("y")), "a", None)) == (0, 0, 0, 100.0, "")
    assert tuple(value(spark, history.diff(F.col("x"), F.col("y")), "", "")) == (0, 0, 0, 100.0, "")


PAGE = """<html><head><title>A  title</title></head><body><header><a href="/">Home</a></header><nav>menu</nav>
<div class="sidebar-ad">Buy now</div><article><h1>Head</h1><p>First <b>bold</b> and <a href="https://x">link</a>.
<p>Second with <code>x = 1</code></p><pre><code>def f():
    return 1
</code></pre><ul><li>one<li>two</ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table>
<blockquote>Said</blockquote></article><aside class=comments>Nice post</aside><footer>Copyright</footer></body></html>"""


def test_readability():
    title, body = readability.readable(PAGE)
    assert title == "A title"
    for part in ("# Head", "**bold**", "[link](https://x)", "`x = 1`", "def f():\n    return 1", "- one\n- two", "| k | v |\n| --- | --- |\n| 1 | 2 |", "> Said"):
        assert part in body
    for part in ("Home", "menu", "Buy now", "Nice post", "Copyright"):
        assert part not in body
    assert readability.readable(PAGE) == (title, body) and readability.readable("") == ("", "")
    nested = "<article>" + "".join(f"<blockquote><p>said {i} " for i in range(800)) + "</article>"
    assert len(readability.readable(nested)[1]) < 5 * len(nested)
    assert "deep inside" in readability.readable("<div>" * 20_000 + "deep inside")[1]


def test_dispatch(spark):
    rows = [("https://a/b?c", '{"b":1,"a":2}', "application/JSON"), ("https://a/b?c", "plain", "text/plain"), ("u", "x", "image/png"), ("u", PAGE, "text/html")]
    got = {r["kind"]: r for r in extraction.dispatch(spark.createDataFrame(rows, "url string, html string, content_type string")).collect()}
    assert got["json"]["text_content"] == '{\n  "a": 2,\n  "b": 1\n}' and got["json"]["title"] == "a/b" and got["json"]["length"] == 13
    assert got["plain"]["text_content"] == "plain" and got["binary"]["length"] == 0
    assert "First **bold**" in got["html"]["text_content"]
    assert value(spark, extraction.parse_mode(F.col("x")), "JSONLD") == "json-ld" and value(spark, extraction.parse_mode(F.col("x")), "nope") == "markdown"


def test_adapters(spark):
    assert value(spark, adapters.reddit_markdown(F.col("x")), "[]") == "(no content returned from Reddit API)\n"
    assert value(spark, adapters.format_timestamp(F.col("x")), "01:02") == "01:02"
    assert value(spark, adapters.json_results(F.col("x"), 3), '{"results":[{"title":"a","url":"u"}]}') is None


def test_config(tmp_path):
    assert config.load(env={}).cache_ttl == 3600 and config.load(env={}).default_extraction_mode == "markdown"
    (tmp_path / "c.toml").write_text('cache_ttl = 5\ncache_max_entry = 7\nhttp_server_port = 9\nother = "x"\nlog_level = 3\n')
    got = config.load(str(tmp_path / "c.toml"), {"CORVANE_CACHE_TTL": "2", "CORVANE_RESPECT_ROBOTS_TXT": "true", "CORVANE_HTTP_SERVER_PORT": "x", "CORVANE_SEARXNG_URL": "http://s"})
    assert (got.cache_ttl, got.cache_max_entry, got.respect_robots_txt, got.http_server_port, got.searxng_url, got.log_level) == (2, 7, True, 9, "http://s", "info")
    for env in ({"CORVANE_CACHE_TTL": "0"}, {"CORVANE_CACHE_MAX_ENTRY": "99999999"}, {"CORVANE_CACHE_COMPRESSION": "zip"}, {"CORVANE_LOG_LEVEL": "loud"}):
        with pytest.raises(config.ConfigError):
            config.load(env=env)
    (tmp_path / "bad.toml").write_text("= 1")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "bad.toml"), {})


def test_store_commands(spark, tmp_path, capsys):
    from corvane import __main__ as cli

    store = str(tmp_path / "store")
    stats = routes.route_stats(seeds.seed_log(spark)).withColumns({c: F.col(c).cast("timestamp") for c in ("last_success_at", "last_check_at")})
    held = entries(spark, 3).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "last_accessed_at", "expires_at")})
    assert "Entries: 0" in cli.status(spark, store)
    route_files.save_store({"routes": stats, "cache": held}, store, 1)
    assert cli.status(spark, store) == "Route cache:\n  Entries: 57\n  Domains: 57\nContent cache:\n  Entries: 3\n  Size: 6 bytes"
    # A version whose manifest is missing isn't there.
    held.limit(1).write.parquet(f"{store}/cache/version=9")
    assert "Size: 6 bytes" in cli.status(spark, store)
    cli.clear(spark, store)
    assert "Size: 0 bytes" in cli.status(spark, store) and "Entries: 57" in cli.status(spark, store)
    (tmp_path / "in.json").write_text(json.dumps([{"domain": "bbc.com", "strategy": "HttpSimple", "avg_latency_ms": 700, "success_rate": 0.2, "total_requests": 4}, {"domain": "new.example", "strategy": "Headless", "avg_latency_ms": 9, "success_rate": 1.0, "total_requests": 1}]))
    assert cli.import_routes(spark, store, str(tmp_path / "in.json")) == 2
    row = cli.open_store(spark, store)[0]["routes"].where("domain = 'bbc.com'").first()
    assert (row["avg_latency_ms"], row["success_rate"], row["total_requests"]) == (600, 0.5, 2)
    assert cli.main(["list"]) == 0 and "page_text" in capsys.readouterr().out
    assert cli.main(["settings"]) == 0 and "cache_ttl: 3600" in capsys.readouterr().out
    assert cli.main(["doctor"]) == 0


def test_replay_does_not_broadcast_exploded_outcomes(spark):
    urls = spark.range(3).select(F.col("id").alias("url"))
    outcomes = urls.select("url", F.explode(F.array(*map(F.lit, routes.STRATEGIES))).alias("strategy"), F.lit("Blocking").alias("error_class"), F.lit(False).alias("is_spa"), F.lit(True).alias("valuable"))
    got = routes.replay(urls.select("url", F.lit("HttpSimple").alias("strategy")), outcomes)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["visited"] for r in got.collect()} == {"HttpSimple,TlsChrome,TlsMobile"}


def test_references_without_semicolon_are_text():
    title, text = readability.readable("<title>A&amp;&amp</title><article><h1>B &lt; C &amp</h1><p>x&copy y&copy; &#39 &#39; &nosuch; &ampx; &&amp;lt; <a href='/?a=1&copy=2&amp;b=3'>z</a> a & b &")
    assert title == "A&&amp"
    assert text == "# B < C &amp\n\nx&copy y© &#39 ' &nosuch; &ampx; &&lt; [z](/?a=1&copy=2&b=3) a & b &"


def test_dispatch_keeps_cut_references_and_their_length(spark):
    pages = spark.createDataFrame([(1, "https://e.example/", "text/html", "<title>a &amp</title><article><h1>a &amp</h1><p>some text</article>")], "page_id long, url string, content_type string, html string")
    row = extraction.dispatch(pages).first()
    assert (row["title"], row["text_content"], row["length"]) == ("a &amp", "# a &amp\n\nsome text", 19)


def test_times_of_years_with_more_digits(spark):
    seconds = [0, 253402300799, 253402300800, 8639900000000 * 1009, -1]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "i long, s long").select("i", evidence.iso(F.col("s")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == ["1970-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "276253589-08-11T22:13:20Z", "1969-12-31T23:59:59Z"]


def test_starred_rules_are_looked_up_as_they_match(spark):
    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    files = [(f"d{d}", "User-agent: *\n" + "\n".join(f"{rng.choice(('Allow', 'Disallow'))}: /{word('ab*é', 7)}" for _ in range(8))) for d in range(12)] + [("every", "User-agent: *\nDisallow: ***\nAllow: a*\nDisallow: *a*b*b\nAllow: .*")]
    rows = [(i, rng.choice(files)[0], f"/{word('abé', 9)}") for i in range(600)] + [(600, "every", ""), (601, "every", "/x.\n*"), (602, None, "/a"), (603, "every", None)]
    robots_files = spark.createDataFrame(files, "domain string, robots_text string")
    pages = spark.createDataFrame(rows, "id long, domain string, path string")
    got = {r["id"]: r["allowed"] for r in robots.decide(pages, robots_files, "Engine").collect()}
    plain = pages.join(robots_files, "domain", "left").select("id", F.coalesce(robots.is_allowed(F.col("path"), robots.parse_rules(F.col("robots_text"), "Engine")), F.lit(True)).alias("allowed"))
    assert got == {r["id"]: r["allowed"] for r in plain.collect()} and 100 < sum(got.values()) < 580


def test_marks_of_html_are_found_by_ascii_case_only(spark):
    given = [m.upper() for m in classify.HTML_ARTIFACTS] + ["<ſcript", "<linK", "blazorXserver.js", "<!--blazor", "__next_data_", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").select("i", classify.has_html_artifact(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in rows] == [True] * len(classify.HTML_ARTIFACTS) + [False] * 5 + [None]


def test_gzip_holds_few_rows_of_a_batch(spark):
    texts = ["é" * i for i in range(1000)] + [None]
    zipped = list(route_files.gzip_bytes.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert max(map(len, zipped)) <= batches.STEP
    back = list(route_files.gunzip_text.func(iter(zipped)))
    assert max(map(len, back)) <= batches.STEP and [x for part in back for x in part.to_pylist()] == texts
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", route_files.gunzip_text(route_files.gzip_bytes("x")).alias("y")).collect()
    assert {r["i"]: r["y"] for r in rows} == dict(enumerate(texts))


def test_citations_hold_few_rows_of_a_batch():
    texts = [f"[a{i}](https://x/{i})" for i in range(1000)] + [None, ""]
    found = list(evidence.citations.func(iter([pa.array(texts)])))
    assert max(map(len, found)) <= batches.STEP
    assert [x if x is None else [c["source_url"] for c in x] for part in found for x in part.to_pylist()] == [[f"https://x/{i}"] for i in range(1000)] + [None, []]


def test_dispatch_of_empty_headings_other_spaces_and_null_pages_is_as_its_sql(spark, tmp_path):
    given = ["<h1></h1><p>a text</p>", "<h1> </h1><p>b</p><p>c</p>", "<h1>H\u00a0x</h1><p>y\u2003 \n z</p>", "<h1>H</h1><p>p</p>", None]
    pages = [(k * 7 + kind, f"https://a.example/{k}?q", h and f"<title>T\u00a0 t</title><article>{h}</article>") for k, h in enumerate(given) for kind in range(7)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.sql(catalog.oracle_sql()["content_dispatch"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["content_dispatch"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) == 35
