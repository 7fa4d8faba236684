"""Queries over documents as Markdown, and over parsers' inputs: budgets, sections, boilerplate, citations, robots, site adapters, subtitles, search pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import adapters, markdown, tokens
from corvane.functions.text import bytes_of
from corvane.operators import boilerplate, evidence, robots, search, sections
from corvane.plans.base import WS, Catalog, sql_lines, sql_prefix, sql_trim
from corvane.sources.tables import dealt, now, pages, table

catalog = Catalog()

#: Documents as Markdown: a first-level heading, and every line that doesn't end with a full stop as a second-level one.
MARKDOWN_SQL = r"""SELECT doc_id, source, '# Doc ' || (doc_id % 7)::VARCHAR || chr(10) || regexp_replace(text, '(?m)^([^\n]{1,60})$', '## \1', 'g') || chr(10) || '[w](https://e.example/' || (doc_id % 9)::VARCHAR || ') [](x) [t](/rel) [w](https://e.example/' || (doc_id % 9)::VARCHAR || ')' AS md FROM documents WHERE text IS NOT NULL"""


def markdown_docs(spark, sf_dir):
    last = (F.col("doc_id") % 9).cast("string")
    md = F.concat(
        F.lit("# Doc "), (F.col("doc_id") % 7).cast("string"), F.lit("\n"), F.regexp_replace("text", r"(?m)^([^\n]{1,60})$", "## $1"), F.lit("\n[w](https://e.example/"), last,
        F.lit(") [](x) [t](/rel) [w](https://e.example/"), last, F.lit(")"),
    )
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", md.alias("md"))


_MD = f"WITH m AS ({MARKDOWN_SQL}) "


@catalog.add(rf"""
WITH t AS (
  SELECT c_custkey, chr(92) || ['-','.','!','*','_','#','`','[',' '][(c_custkey % 9 + 1)::INT] || 'a ' || chr(92) || '* b' || chr(92) || chr(10) ||
    repeat('#', (c_custkey % 8)::INT) || 'Head ' || c_name || chr(10)
    || '####### seven' || chr(10) || '# ok' || repeat(chr(10), (c_custkey % 6 + 1)::INT) || '[gone ' || c_name || ']() [kept](u) [x' ||
      repeat(chr(10), (c_custkey % 3)::INT) AS x FROM customer
),
a AS (SELECT c_custkey, regexp_replace(x, '\\([^*_#\[\]\\`~\s])', '\1', 'g') AS x FROM t), b AS (SELECT c_custkey, regexp_replace(x,
  '(?m)^(#{{1,6}})([^ \n#])', '\1 \2', 'g') AS x FROM a),
c AS (SELECT c_custkey, regexp_replace(regexp_replace(x, '\[([^\]]*)\]\(\)', '\1', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS x FROM b)
  SELECT c_custkey, {sql_trim('x')} AS md FROM c
""")
def markdown_clean(spark, sf_dir):
    k = F.col("c_custkey")
    mark = F.get(F.array(*map(F.lit, "-.!*_#`[ ")), (k % 9).cast("int"))
    x = F.concat(
        F.lit("\\"), mark, F.lit("a \\* b\\\n"), F.repeat(F.lit("#"), (k % 8).cast("int")), F.lit("Head "), "c_name", F.lit("\n####### seven\n# ok"), F.repeat(F.lit("\n"), (k % 6 + 1).cast("int")),
        F.lit("[gone "), "c_name", F.lit("]() [kept](u) [x"), F.repeat(F.lit("\n"), (k % 3).cast("int")),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", markdown.clean(x).alias("md"))


@catalog.add(_MD + "SELECT doc_id, strlen(md) // 4 AS tokens FROM m")
def token_estimate(spark, sf_dir):
    return markdown_docs(spark, sf_dir).select("doc_id", tokens.estimate(F.col("md")).alias("tokens"))


_BUDGETED = "a AS (SELECT doc_id, md AS t, (doc_id % 50 * 7)::INT AS b FROM m)"


def _budgeted(spark, sf_dir):
    """Budgets that cut inside characters, too."""
    return markdown_docs(spark, sf_dir).select("doc_id", F.col("md").alias("t"), (F.col("doc_id") % 50 * 7).cast("int").alias("b"))


@catalog.add(_MD + ", " + _BUDGETED + f"""
SELECT doc_id, CASE WHEN b = 0 OR strlen(t) <= 4 * b THEN t ELSE {sql_prefix('t', '(4 * b)')} || chr(10) || chr(10) || '[... truncated to fit token budget]' END AS text,
  CASE WHEN strlen(t) > 91 THEN {sql_prefix('t', '91')} || ' [...]' ELSE t END AS preview FROM a
""")
def token_budget(spark, sf_dir):
    return _budgeted(spark, sf_dir).select("doc_id", tokens.apply_budget(F.col("t"), F.col("b")).alias("text"), tokens.preview(F.col("t"), 91).alias("preview"))


@catalog.add(_MD + ", " + _BUDGETED + rf""", h AS (SELECT doc_id, t, b, {sql_prefix('t', '(4 * b)')} AS h FROM a)
SELECT doc_id, strlen(t) > 4 * b AS truncated, CASE WHEN strlen(t) <= 4 * b THEN t WHEN contains(h, chr(10) || chr(10)) THEN regexp_extract(h, '(?s)^(.*)\n\n', 1)
  WHEN contains(h, '. ') THEN regexp_extract(h, '(?s)^(.*\.) ', 1) WHEN contains(h, ' ') THEN regexp_extract(h, '(?s)^(.*) ', 1) ELSE h END AS text FROM h
""")
def truncate_boundary(spark, sf_dir):
    return _budgeted(spark, sf_dir).select("doc_id", tokens.truncate_to_budget(F.col("t"), F.col("b")).alias("r")).select("doc_id", "r.truncated", "r.text")


_SECTION_LIMIT = 480
_USABLE = _SECTION_LIMIT - len(tokens.SECTION_MARK)
_SECTION_MARK = "chr(10) || chr(10) || '[... truncated ...]'"


@catalog.add(rf"""
WITH RECURSIVE m AS ({MARKDOWN_SQL}), s AS (
  SELECT doc_id, md, CASE WHEN contains(md, chr(10) || '## ') THEN list_filter(string_split(replace(md, chr(10) || '## ', chr(1) || '## '), chr(1)),
    lambda x: x <> '') ELSE string_split(md, chr(10) || chr(10)) END AS parts FROM m
), loop AS (
  SELECT doc_id, 0 AS i, 0::BIGINT AS held, []::VARCHAR[] AS kept FROM s
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN need <= {_USABLE} THEN need ELSE held END, CASE WHEN need <= {_USABLE} THEN list_append(kept, part) ELSE kept END FROM (
    SELECT loop.doc_id, i, held, kept, parts[i + 1] AS part, held + strlen(parts[i + 1]) + CASE WHEN len(kept) = 0 THEN 0 ELSE 2 END AS need FROM
      loop JOIN s ON loop.doc_id = s.doc_id WHERE i < len(parts))
), done AS (
  SELECT s.doc_id, md, parts, array_to_string(kept, chr(10) || chr(10)) AS joined FROM loop JOIN s ON loop.doc_id = s.doc_id AND i = len(parts)
)
SELECT doc_id, CASE WHEN strlen(md) <= {_SECTION_LIMIT} THEN md WHEN len(parts) <= 1 THEN regexp_replace({sql_prefix('md', str(_USABLE))}, '{WS}+\z',
  '') || {_SECTION_MARK}
  WHEN strlen(joined) < strlen(md) THEN joined || {_SECTION_MARK} ELSE joined END AS text FROM done
""")
def truncate_sections(spark, sf_dir):
    return markdown_docs(spark, sf_dir).select("doc_id", tokens.truncate_sections(F.col("md"), F.lit(_SECTION_LIMIT // 4)).alias("text"))


@catalog.add(_MD + rf""", l AS (
  SELECT doc_id, md, unnest({sql_lines('md')}) AS line, generate_subscripts({sql_lines('md')}, 1) AS pos FROM m
), f AS (
  SELECT *, regexp_matches(line, '^{WS}*#') AS head, sum(strlen(line)) OVER w AS total, min(CASE WHEN line <> '' THEN pos END) OVER (PARTITION BY
    doc_id) AS first_text FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), h AS (
  SELECT *, CASE WHEN pos < first_text THEN 0 ELSE total + pos - first_text END AS held FROM f
), p AS (
  SELECT *, coalesce(lag(held) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM h
), c AS (
  SELECT doc_id, coalesce(min(CASE WHEN head AND before > 0 AND before + strlen(line) + 1 > 480 THEN pos END) - 1, max(pos)) AS n FROM p GROUP BY doc_id
), g AS (
  SELECT p.doc_id, any_value(md) AS md, coalesce(string_agg('- ' || {sql_trim("regexp_replace(" + sql_trim('line') + ", '^#+', '')")}, chr(10) ORDER
    BY pos) FILTER (WHERE head), '') AS toc,
    regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE pos <= n), ''), '^
+', '') AS taken, coalesce(max(CASE WHEN head AND pos <= n THEN held END), 0) AS broke
  FROM p JOIN c ON p.doc_id = c.doc_id GROUP BY p.doc_id
), b AS (
  SELECT *, CASE WHEN strlen(taken) > 960 AND broke > 0 THEN {sql_prefix('taken', 'broke')} ELSE taken END AS body FROM g
)
SELECT doc_id, strlen(md) > 480 AS truncated, CASE WHEN strlen(md) <= 480 THEN md WHEN toc <> '' THEN '{tokens.TOC_TITLE}' || chr(10) || toc ||
  chr(10) || chr(10) || body ELSE body END AS text FROM b
""")
def truncate_smart(spark, sf_dir):
    return markdown_docs(spark, sf_dir).select("doc_id", tokens.truncate_smart(F.col("md"), F.lit(120)).alias("r")).select("doc_id", "r.truncated", "r.text")


_SECTIONS = _MD + rf""", l AS (SELECT doc_id, source, unnest({sql_lines('md')}) AS line, generate_subscripts({sql_lines('md')}, 1) AS pos FROM m),
h AS (SELECT *, regexp_replace(line, '^{WS}+', '') AS left_line, len(regexp_extract(regexp_replace(line, '^{WS}+', ''), '^(#*)', 1)) AS marks FROM l),
g AS (SELECT *, sum((marks BETWEEN 1 AND 6)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM h),
s AS (SELECT doc_id, source, sec, coalesce(max(CASE WHEN marks BETWEEN 1 AND 6 THEN marks END), 0)::INT AS level, coalesce(max(CASE WHEN marks
  BETWEEN 1 AND 6 THEN {sql_trim("regexp_replace(left_line, '^#+', '')")} END), '') AS heading,
  coalesce(regexp_replace(string_agg(CASE WHEN marks BETWEEN 1 AND 6 THEN NULL ELSE line END, chr(10) ORDER BY pos), '^\n+', ''), '') AS content FROM
    g GROUP BY doc_id, source, sec),
sections AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INT AS section_idx, level, heading, content FROM s WHERE heading <> '' OR content <> '') """


def _sections(spark, sf_dir):
    docs = markdown_docs(spark, sf_dir)
    return docs.select("doc_id", "source", F.posexplode(sections.parse_sections(F.col("md"))).alias("section_idx", "s")).select("doc_id", "source", "section_idx", "s.heading", "s.content", F.col("s.level").cast("int").alias("level"))


@catalog.add(_SECTIONS + "SELECT doc_id, section_idx, level, heading, content FROM sections")
def markdown_sections(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "section_idx", "level", "heading", "content")


FOCUS = "The doc, (an) über!"
_WORDS = ["the", "doc", "an", "über"]


@catalog.add(_SECTIONS + f""", k AS (SELECT *, lower(heading || ' ' || content) AS both_texts, lower(heading) AS head FROM sections),
r AS (SELECT doc_id, section_idx, len(list_filter({_WORDS!r}, lambda w: contains(both_texts, w))) AS hits, len(list_filter({_WORDS!r}, lambda w:
  contains(both_texts, w))) / 4 + 0.5 * len(list_filter({_WORDS!r}, lambda w: contains(head, w))) / 4 + CASE WHEN strlen(content) > 0 THEN
  greatest(log2(strlen(content)), 0) / 10 ELSE 0 END AS score FROM k)
SELECT doc_id, section_idx, hits::INT AS hits, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, section_idx)::INT AS rank FROM r""")
def focus_rank(spark, sf_dir):
    ranked = sections.rank_sections(_sections(spark, sf_dir), "doc_id", FOCUS)
    return ranked.select("doc_id", "section_idx", "hits", F.round("score", 6).alias("score"), "rank")


@catalog.add(_SECTIONS + f""", k AS (SELECT *, lower(heading || ' ' || content) AS both_texts, lower(heading) AS head FROM sections),
r AS (
  SELECT doc_id, section_idx, CASE WHEN heading = '' THEN content ELSE heading || chr(10) || content END AS shown,
    len(list_filter({_WORDS!r}, lambda w: contains(both_texts, w))) / 4 + 0.5 * len(list_filter({_WORDS!r}, lambda w: contains(head, w))) / 4 + CASE
      WHEN strlen(content) > 0 THEN greatest(log2(strlen(content)), 0) / 10 ELSE 0 END AS score FROM k
)
SELECT m.doc_id, coalesce(string_agg(shown, chr(10) || chr(10) ORDER BY round(score, 9) DESC, section_idx) FILTER (WHERE score > 0), any_value(md))
  AS text FROM m LEFT JOIN r ON m.doc_id = r.doc_id GROUP BY m.doc_id
""")
def focus_text(spark, sf_dir):
    return markdown_docs(spark, sf_dir).select("doc_id", sections.focused_text(F.col("md"), FOCUS).alias("text"))


_PROFILE = _SECTIONS + """, p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM sections GROUP BY source), n AS (SELECT source, lower(heading) AS heading, count(*) AS n FROM sections WHERE heading <> '' GROUP BY 1, 2),
structural AS (SELECT n.source, heading, n, n / pages AS ratio FROM n JOIN p ON n.source = p.source WHERE n / pages >= 0.5) """


def _profile(spark, sf_dir):
    return sections.domain_profile(_sections(spark, sf_dir), "source", "doc_id")


@catalog.add(_PROFILE + "SELECT source, heading, n, round(ratio, 6) AS ratio FROM structural")
def structural_headings(spark, sf_dir):
    pages_, headings, _ = _profile(spark, sf_dir)
    return sections.structural_headings(pages_, headings, "source").select("source", "heading", "n", F.round("ratio", 6).alias("ratio"))


@catalog.add(_SECTIONS +
    ", p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM sections GROUP BY source), n AS (SELECT source, lower(heading) AS heading, count(*) AS n "
    "FROM sections WHERE heading <> '' GROUP BY 1, 2) SELECT source, heading, n, pages FROM n JOIN p USING (source) WHERE n > 1"
)
def heading_counts(spark, sf_dir):
    pages_, headings, _ = _profile(spark, sf_dir)
    return headings.where("n > 1").join(pages_, "source").select("source", "heading", "n", "pages")


@catalog.add(_SECTIONS +
    ", n AS (SELECT source, lower(heading) AS heading, count(*) AS n FROM sections WHERE heading <> '' GROUP BY 1, 2), p AS (SELECT source, count(DISTINCT "
    "doc_id) AS pages FROM sections GROUP BY source) SELECT doc_id, section_idx, round(strlen(content) * (1 - CASE WHEN n.n / p.pages >= 0.5 THEN n.n / "
    "p.pages ELSE 0 END) + 0.0, 6) AS adjusted FROM sections s JOIN p ON s.source = p.source LEFT JOIN n ON s.source = n.source AND lower(s.heading) = "
    "n.heading"
)
def structural_adjust(spark, sf_dir):
    rows = _sections(spark, sf_dir).withColumn("score", bytes_of(F.col("content")).cast("double"))
    pages_, headings, _ = sections.domain_profile(rows, "source", "doc_id")
    adjusted = sections.adjust_scores(rows, sections.structural_headings(pages_, headings, "source"), "source")
    return adjusted.select("doc_id", "section_idx", F.round("adjusted", 6).alias("adjusted"))


@catalog.add(_SECTIONS +
    ", c AS (SELECT source, level, count(*) AS n FROM sections WHERE heading <> '' GROUP BY 1, 2) SELECT source, level FROM (SELECT *, row_number() OVER "
    "(PARTITION BY source ORDER BY n DESC, level) AS k FROM c) WHERE k = 1"
)
def dominant_level(spark, sf_dir):
    return sections.dominant_level(_profile(spark, sf_dir)[2], "source")


_BLOCKS = f"""WITH l AS (SELECT source, doc_id, unnest({sql_lines('text')}) AS line, generate_subscripts({sql_lines('text')}, 1) AS pos FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, {sql_trim('line')} AS block FROM l), h AS (SELECT *, CASE WHEN block <> '' AND strlen(block) <= 2000 THEN sha256(block) END AS block_hash FROM b),
n AS (SELECT source, block_hash, count(*) AS n FROM h WHERE block_hash IS NOT NULL GROUP BY 1, 2) """


def _blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = boilerplate.exploded(docs, "source", "doc_id", "text")
    return docs, boilerplate.boilerplate(boilerplate.block_counts(rows, "source"))


@catalog.add(_BLOCKS + "SELECT source, block_hash, n FROM n WHERE n >= 3")
def boilerplate_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)[1]


@catalog.add(_BLOCKS +
    "SELECT h.source, doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE n.n IS NULL OR n.n < 3), '') AS text FROM h LEFT JOIN n ON "
    "h.source = n.source AND h.block_hash = n.block_hash GROUP BY h.source, doc_id"
)
def boilerplate_strip(spark, sf_dir):
    docs, marks = _blocks(spark, sf_dir)
    return boilerplate.strip(docs, marks, "source", "doc_id", "text")


@catalog.add(_BLOCKS + "SELECT source, count(*) AS blocks FROM n WHERE n >= 3 AND source <> 'src0' GROUP BY source")
def boilerplate_counts(spark, sf_dir):
    marks = boilerplate.clear_domain(_blocks(spark, sf_dir)[1], "source", "src0")
    return boilerplate.domain_counts(marks, "source")


@catalog.add(_MD + "SELECT doc_id, 1 AS n, 'w' AS text, 'https://e.example/' || (doc_id % 9)::VARCHAR AS source_url FROM m")
def citations(spark, sf_dir):
    rows = markdown_docs(spark, sf_dir).select("doc_id", evidence.citations(F.col("md")).alias("c"))
    # For explode, Spark would filter by the array's size first, and find the citations twice.
    return rows.select("doc_id", F.size("c").alias("n"), F.explode_outer("c").alias("x")).where("x is not null").select("doc_id", "n", "x.text", "x.source_url")


_CITING = "'Intro ' || c_name || ' [see [' || k || '] here](https://x.example/' || k || ') and' || chr(10) || '[b](/rel) [c]( http://y.example/' || k || ' ) [[open [d](https://x.example/' || k || ') [ ](https://z.example) [e](https://v.example/' || c_custkey::VARCHAR || ')'"


@catalog.add(f"""
WITH t AS (SELECT c_custkey, k, {_CITING} AS x, position('[see' IN {_CITING}) - 1 AS a, position('[c]' IN {_CITING}) - 1 AS b, position('[e]' IN
  {_CITING}) - 1 AS e FROM (SELECT *, (c_custkey % 7)::VARCHAR AS k FROM customer)),
c AS (
  SELECT c_custkey, 0 AS pos, 'see [' || k || '] here' AS text, 'https://x.example/' || k AS source_url, a AS place, x FROM t
  UNION ALL SELECT c_custkey, 1, 'c', 'http://y.example/' || k, b, x FROM t
  UNION ALL SELECT c_custkey, 2, 'e', 'https://v.example/' || c_custkey::VARCHAR, e, x FROM t
)
SELECT c_custkey, pos, text, source_url,
  {sql_trim("string_split(substr(x, (greatest(0, place - 40) + 1)::BIGINT, (least(strlen(x), place + 60) - greatest(0, place - 40))::BIGINT), chr(10))[1]")}
  AS context FROM c
""")
def citation_context(spark, sf_dir):
    """Nested and unbalanced brackets, relative, empty and repeated targets, each with its context."""
    k = (F.col("c_custkey") % 7).cast("string")
    x = F.concat(F.lit("Intro "), "c_name", F.lit(" [see ["), k, F.lit("] here](https://x.example/"), k, F.lit(") and\n[b](/rel) [c]( http://y.example/"), k, F.lit(" ) [[open [d](https://x.example/"), k, F.lit(") [ ](https://z.example) [e](https://v.example/"), F.col("c_custkey").cast("string"), F.lit(")"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(evidence.citations(x)).alias("pos", "c"))
    return rows.select("c_custkey", "pos", "c.text", "c.source_url", "c.context")


@catalog.add("SELECT 'd' || c_custkey::VARCHAR AS domain FROM customer WHERE c_custkey * 97 % 7200 <= 3600")
def robots_fresh(spark, sf_dir):
    age = F.make_dt_interval(secs=(F.col("c_custkey") * 97 % 7200).cast("decimal(18,6)"))
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("domain"), F.lit("User-agent: *").alias("robots_text"), (now() - age).alias("fetched_at"))
    return robots.fresh(files, now()).select("domain")


_ROBOTS = ("User-agent: *\nDisallow: /w\nAllow: /wh\n\nUser-agent: other\nDisallow: /\n", "User-agent: Engine\nDisallow: /*s*e\nUser-agent: *\nDisallow: /\n", "User-agent: engine\nUser-agent: x\nDisallow: /\n", "# none\nDisallow: /\n", "User-agent: *\nDisallow: \nDisallow: /f\nAllow: /f\n")


_ROBOT_WORDS = ("what", "we", "fe", "sane")
# Robots files of twelve domains: one rule a part, thousands a domain at larger scales, beside the short files above.
_ROBOT_FILES = f"""
SELECT 'd' || (p_partkey % 12)::VARCHAR AS domain, CASE p_partkey % 12 WHEN 0 THEN 'User-agent: *' WHEN 1 THEN 'User-agent: engine' ELSE 'User-agent: Engine' END || chr(10) ||
  string_agg(CASE WHEN p_partkey % 5 < 2 THEN 'Allow: ' ELSE 'Disallow: ' END || CASE WHEN p_partkey % 40 < 12 THEN '/*' ELSE '' END || '/' || {list(_ROBOT_WORDS)}[(p_partkey % 4 + 1)::INT] || '/' || (p_partkey * 7 % 389)::VARCHAR
    || CASE WHEN p_partkey % 3 = 0 THEN left(replace(p_name, ' ', '/'), 4) ELSE '' END, chr(10) ORDER BY p_partkey)
  || CASE WHEN p_partkey % 12 = 2 THEN chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /' ELSE '' END AS txt
FROM part GROUP BY p_partkey % 12
"""


@catalog.add(f"""
WITH files AS ({_ROBOT_FILES} UNION ALL SELECT 'e' || i::VARCHAR, {[t.replace(chr(10), "|") for t in _ROBOTS]}[i + 1] FROM range({len(_ROBOTS)}) AS r(i)),
split AS (SELECT domain, string_split(replace(txt, '|', chr(10)), chr(10)) AS ls FROM files),
line AS (SELECT domain, i, {sql_trim('ls[i]')} AS l FROM split, unnest(range(1, len(ls) + 1)) AS u(i)),
kinds AS (SELECT domain, i, CASE WHEN starts_with(l, 'User-agent:') THEN 'agent' WHEN starts_with(l, 'Disallow:') THEN 'deny' WHEN starts_with(l, 'Allow:') THEN 'allow' END AS kind, {sql_trim("regexp_replace(l, '^[^:]*:', '')")} AS rule FROM line),
grouped AS (SELECT *, max(CASE WHEN kind = 'agent' THEN i END) OVER (PARTITION BY domain ORDER BY i) AS g FROM kinds),
chosen AS (SELECT domain, coalesce(max(i) FILTER (lower(rule) = 'engine'), max(i) FILTER (rule = '*')) AS g FROM kinds WHERE kind = 'agent' GROUP BY domain),
rules AS (SELECT domain, kind, rule FROM grouped JOIN chosen USING (domain, g) WHERE kind IN ('allow', 'deny') AND rule <> ''),
p AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || (o_orderkey % 6)::VARCHAR ELSE 'd' || (o_custkey % 13)::VARCHAR END AS domain,
    CASE WHEN o_orderkey % 5 = 0 THEN '/dir' ELSE '' END || '/' || {list(_ROBOT_WORDS)}[(o_orderkey % 4 + 1)::INT] || CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 97)::VARCHAR ELSE '/' || (o_custkey * 11 % 389)::VARCHAR || lower(left(o_orderpriority, 3)) END AS path FROM orders
),
found AS (
  SELECT o_orderkey, coalesce(max(strlen(rule)) FILTER (kind = 'allow'), 0) AS a, coalesce(max(strlen(rule)) FILTER (kind = 'deny'), 0) AS n FROM p JOIN rules USING (domain)
  WHERE CASE WHEN contains(rule, '*') THEN regexp_matches(path, '(?s)' || array_to_string(list_transform(string_split(rule, '*'), lambda x: regexp_escape(x)), '.*')) ELSE starts_with(path, rule) END GROUP BY o_orderkey
)
SELECT p.o_orderkey, p.domain, path, coalesce((a >= n AND a > 0) OR n = 0, true) AS allowed FROM p LEFT JOIN found USING (o_orderkey)
""")
def robots_allowed(spark, sf_dir):
    k, c, part = F.col("o_orderkey"), F.col("o_custkey"), F.col("p_partkey")
    word = lambda n: F.get(F.array(*map(F.lit, _ROBOT_WORDS)), (n % 4).cast("int"))
    tail = F.when(k % 3 == 0, (k % 97).cast("string")).otherwise(F.concat(F.lit("/"), (c * 11 % 389).cast("string"), F.lower(F.left("o_orderpriority", F.lit(3)))))
    domain = F.when(k % 3 == 0, F.concat(F.lit("e"), (k % 6).cast("string"))).otherwise(F.concat(F.lit("d"), (c % 13).cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", domain.alias("domain"), F.concat(F.when(k % 5 == 0, "/dir").otherwise(""), F.lit("/"), word(k), tail).alias("path"))
    rule = F.concat(F.when(part % 5 < 2, "Allow: ").otherwise("Disallow: "), F.when(part % 40 < 12, "/*").otherwise(""), F.lit("/"), word(part), F.lit("/"), (part * 7 % 389).cast("string"), F.when(part % 3 == 0, F.left(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(4))).otherwise(""))
    ruled = table(spark, sf_dir, "part").select((part % 12).alias("d"), part.alias("k"), rule.alias("rule")).groupBy("d").agg(F.array_sort(F.collect_list(F.struct("k", "rule"))).alias("r"))
    head = F.when(F.col("d") == 0, "User-agent: *\n").when(F.col("d") == 1, "User-agent: engine\n").otherwise("User-agent: Engine\n")
    text = F.concat(head, F.array_join("r.rule", "\n"), F.when(F.col("d") == 2, "\nUser-agent: *\nDisallow: /").otherwise(""))
    files = ruled.select(F.concat(F.lit("d"), F.col("d").cast("string")).alias("domain"), text.alias("robots_text"))
    short = spark.createDataFrame([(f"e{i}", t) for i, t in enumerate(_ROBOTS)], "domain string, robots_text string")
    return robots.decide(rows, files.unionByName(short), "Engine").select("o_orderkey", "domain", "path", "allowed")


_STRICT = "replace(replace(url_encode(url), '%7E', '~'), '*', '%2A')"


@catalog.add(f"""
WITH t AS (SELECT c_custkey, c_custkey % 11 AS k, c_custkey::VARCHAR AS n, lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS three FROM customer),
u AS (
  SELECT *, CASE k WHEN 0 THEN 'https://www.reddit.com/r/a/comments/' || n || '/?sort=top' WHEN 1 THEN 'http://old.reddit.com/x' || n || '.json' WHEN 2 THEN 'https://news.ycombinator.com/item?a=1&id=' || n
    WHEN 3 THEN 'https://hackernews.com/item' || n WHEN 4 THEN 'https://youtu.be/abcdefgh' || three || '?t=1' WHEN 5 THEN 'https://www.YouTube.com/watch?x=1&v=ABC_d-' || three || 'fg12345'
    WHEN 6 THEN 'https://m.youtube.com/embed/abcdefgh' || three || 'l?x' WHEN 7 THEN 'https://youtube.com/watch?v=short' || three WHEN 8 THEN 'https://example.com/watch?v=abcdefgh' || three
    WHEN 9 THEN 'https://youtube.com/channel/abcdefgh' || three ELSE 'https://reddit.com' END AS url FROM t
)
SELECT c_custkey, url, CASE WHEN k IN (0, 1, 10) THEN 'reddit' WHEN k IN (2, 3) THEN 'hn' WHEN k IN (4, 5, 6, 7, 9) THEN 'video' END AS site,
  CASE k WHEN 0 THEN 'https://www.reddit.com/r/a/comments/' || n || '.json?sort=top' WHEN 1 THEN 'https://www.reddit.com/x' || n || '.json' WHEN 2 THEN 'https://hacker-news.firebaseio.com/v0/item/' || n || '.json'
    WHEN 3 THEN NULL WHEN 8 THEN NULL WHEN 10 THEN 'https://www.reddit.com.json' ELSE 'https://noembed.com/embed?url=' || {_STRICT} END AS api,
  CASE k WHEN 4 THEN 'abcdefgh' || three WHEN 5 THEN 'ABC_d-' || three || 'fg' WHEN 6 THEN 'abcdefgh' || three WHEN 8 THEN 'abcdefgh' || three END AS video_id, k IN (4, 5, 6, 7) AS is_video FROM u
""")
def site_urls(spark, sf_dir):
    n, three = _key().cast("string"), F.lpad((_key() % 1000).cast("string"), 3, "0")
    shapes = (
        ("https://www.reddit.com/r/a/comments/", n, "/?sort=top"), ("http://old.reddit.com/x", n, ".json"), ("https://news.ycombinator.com/item?a=1&id=", n), ("https://hackernews.com/item", n),
        ("https://youtu.be/abcdefgh", three, "?t=1"), ("https://www.YouTube.com/watch?x=1&v=ABC_d-", three, "fg12345"), ("https://m.youtube.com/embed/abcdefgh", three, "l?x"),
        ("https://youtube.com/watch?v=short", three), ("https://example.com/watch?v=abcdefgh", three), ("https://youtube.com/channel/abcdefgh", three), ("https://reddit.com",),
    )
    urls = F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in shape]) for shape in shapes])
    rows = _customers(spark, sf_dir).select("c_custkey", F.get(urls, (_key() % len(shapes)).cast("int")).alias("url"))
    x = F.col("url")
    return rows.select("c_custkey", "url", adapters.site(x).alias("site"), adapters.api_url(x).alias("api"), adapters.video_id(x).alias("video_id"), adapters.is_video_page(x).alias("is_video"))


def _customers(spark, sf_dir):
    return dealt(table(spark, sf_dir, "customer"), "c_custkey")


def _key():
    return F.col("c_custkey")


_NL = "chr(10) || chr(10)"


@catalog.add(f"""
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '(no content returned from Reddit API)' || chr(10) ELSE
  '# ' || CASE WHEN c_custkey % 5 = 0 THEN '(untitled)' ELSE c_name END || {_NL} || '**r/s' || (c_custkey % 3)::VARCHAR || '** · u/' || CASE WHEN
    c_custkey % 2 = 0 THEN '[deleted]' ELSE 'me' END || ' · ⬆ ' || (c_custkey % 90)::VARCHAR || {_NL}
  || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'self' || {_NL} END || '---' || {_NL} || '## Top Comments' || {_NL}
  || coalesce((SELECT string_agg('**u/a' || i::VARCHAR || '** (⬆ ' || i::VARCHAR || ')' || {_NL} || 'b' || {_NL} || '---' || {_NL}, '' ORDER BY i)
    FROM range(5) t(i) WHERE i < c_custkey % 8), '') END AS md
FROM customer
""")
def reddit_md(spark, sf_dir):
    comments = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < _key() % 8, F.format_string('{"data":{"author":"a%d","score":%d,"body":"b"}}', i, i))), ",")
    title = F.when(_key() % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"title":"'), "c_name", F.lit('",')))
    author = F.when(_key() % 2 == 0, F.lit("")).otherwise(F.lit('"author":"me",'))
    says = F.when(_key() % 4 == 0, F.lit("")).otherwise(F.lit("self"))
    post = F.concat(F.lit('{"data":{'), title, author, F.lit('"subreddit":"s'), (_key() % 3).cast("string"), F.lit('","score":'), (_key() % 90).cast("string"), F.lit(',"selftext":"'), says, F.lit('"}}'))
    doc = F.concat(F.lit('[{"data":{"children":['), post, F.lit(']}},{"data":{"children":['), comments, F.lit("]}}]"))
    return _customers(spark, sf_dir).select("c_custkey", adapters.site_markdown(F.lit("https://reddit.com/r"), F.when(_key() % 11 == 0, "[]").otherwise(doc)).alias("md"))


@catalog.add(f"""
SELECT c_custkey, '# ' || CASE WHEN c_custkey % 6 = 0 THEN '(untitled)' ELSE c_name END || {_NL} || '**Hacker News** · by ' || CASE WHEN c_custkey %
  3 = 0 THEN 'me' ELSE '[unknown]' END || ' · ⬆ ' || (c_custkey % 100)::VARCHAR || ' · 💬 '
  || CASE WHEN c_custkey % 4 = 0 THEN c_custkey::VARCHAR ELSE '0' END || {_NL} || CASE WHEN c_custkey % 2 = 0 THEN 'body é' || {_NL} ELSE '' END
  || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '**Link:** [https://x.example/' || c_custkey::VARCHAR || '](https://x.example/' || c_custkey::VARCHAR
    || ')' || chr(10) END AS md FROM customer
""")
def hn_md(spark, sf_dir):
    optional = lambda when, *parts: F.when(when, F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])).otherwise("")
    doc = F.concat(
        F.lit('{"score":'), (_key() % 100).cast("string"), optional(_key() % 6 != 0, ',"title":"', F.col("c_name"), '"'), optional(_key() % 3 == 0, ',"by":"me"'), optional(_key() % 4 == 0, ',"descendants":', _key().cast("string")),
        optional(_key() % 2 == 0, ',"text":"body é"'), optional(_key() % 5 != 0, ',"url":"https://x.example/', _key().cast("string"), '"'), F.lit("}"),
    )
    return _customers(spark, sf_dir).select("c_custkey", adapters.site_markdown(F.lit("https://news.ycombinator.com/item?id=1"), doc).alias("md"))


@catalog.add(f"""
SELECT c_custkey, '# ' || CASE WHEN c_custkey % 7 = 0 THEN '(untitled)' ELSE c_name END || {_NL} || '**Channel:** ' || CASE WHEN c_custkey % 5 = 0
  THEN '[unknown]' ELSE 'c' || c_custkey::VARCHAR END || {_NL}
  || CASE c_custkey % 3 WHEN 0 THEN '![thumbnail](t' || c_custkey::VARCHAR || ')' || {_NL} WHEN 1 THEN '⚠ _bad_' || chr(10) ELSE '' END AS md FROM customer
""")
def oembed_md(spark, sf_dir):
    title = F.when(_key() % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"title":"'), "c_name", F.lit('",')))
    author = F.when(_key() % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"author_name":"c'), _key().cast("string"), F.lit('",')))
    rest = F.when(_key() % 3 == 0, F.concat(F.lit('"thumbnail_url":"t'), _key().cast("string"), F.lit('"}'))).when(_key() % 3 == 1, F.lit('"error":"bad"}')).otherwise('"thumbnail_url":""}')
    return _customers(spark, sf_dir).select("c_custkey", adapters.site_markdown(F.lit("https://youtu.be/x"), F.concat(F.lit("{"), title, author, rest)).alias("md"))


_LEAD = "lpad((c_custkey % 60)::VARCHAR, 2, '0')"


def _vtt():
    """A cue with tags and two lines, one without text, one of hours by key, and text behind no time."""
    minute = F.lpad((_key() % 60).cast("string"), 2, "0")
    late = F.when(_key() % 4 == 0, F.concat(F.lit("\n0"), (_key() % 9 + 1).cast("string"), F.lit(":"), minute, F.lit(":07.000 --> z\nlate é\n"))).otherwise("")
    return F.concat(F.lit("WEBVTT\nKind: captions\nLanguage: en\n\n00:"), minute, F.lit(":01.000 --> 00:59:02.000\n<c>Hello</c> "), "c_name", F.lit("\nmore\n\n01:02:03.500 --> x\n"), late, F.lit("00:05:06.1 --> y\nlast <b>line"))


_CUES = f"""
SELECT c_custkey, 0 AS pos, '00:' || {_LEAD} || ':01.000' AS ts, 'Hello ' || c_name || ' more' AS text, '[' || (c_custkey % 60)::VARCHAR || ':01]' AS shown FROM customer
UNION ALL SELECT c_custkey, 1, '0' || (c_custkey % 9 + 1)::VARCHAR || ':' || {_LEAD} || ':07.000', 'late é', '[' || (c_custkey % 9 + 1)::VARCHAR ||
  ':' || {_LEAD} || ':07]' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END, '00:05:06.1', 'last line', '[5:06]' FROM customer
"""


@catalog.add(_CUES)
def vtt_cues(spark, sf_dir):
    rows = _customers(spark, sf_dir).select("c_custkey", F.posexplode(adapters.vtt_cues(_vtt())).alias("pos", "c"))
    return rows.select("c_custkey", "pos", "c.ts", "c.text", adapters.format_timestamp(F.col("c.ts")).alias("shown"))


@catalog.add(f"""
SELECT c_custkey, '0' || (c_custkey % 3)::VARCHAR || ':' || {_LEAD} || ':00,5' AS ts, c_name || ' x' AS text,
  CASE WHEN c_custkey % 3 = 0 THEN '[' || (c_custkey % 60)::VARCHAR || ':00,5]' ELSE '[' || (c_custkey % 3)::VARCHAR || ':' || {_LEAD} || ':00,5]'
    END AS shown FROM customer
UNION ALL SELECT c_custkey, '01:00:00,5', ' ', '[1:00:00,5]' FROM customer WHERE c_custkey % 2 = 0
""")
def srt_cues(spark, sf_dir):
    first = F.concat(F.lit("1\n0"), (_key() % 3).cast("string"), F.lit(":"), F.lpad((_key() % 60).cast("string"), 2, "0"), F.lit(":00,5 --> 01:00:01\n<i>"), "c_name", F.lit("</i>\nx\n\n2\nonly two\n\n"))
    doc = F.concat(first, F.when(_key() % 2 == 0, "1\n01:00:00,5 --> z\n<i> </i>\n").otherwise("3\n01:00:00,5 --> z\n<i></i>\n"))
    rows = _customers(spark, sf_dir).select("c_custkey", F.explode(adapters.srt_cues(doc)).alias("c"))
    return rows.select("c_custkey", "c.ts", "c.text", adapters.format_timestamp(F.col("c.ts")).alias("shown"))


@catalog.add(f"""
WITH cues AS ({_CUES}), said AS (SELECT c_custkey, string_agg('**' || shown || '** ' || text || {_NL}, '' ORDER BY pos) AS lines FROM cues GROUP BY c_custkey)
SELECT c.c_custkey, '# ' || c_name || {_NL} || CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE '**Duration:** ' || (c.c_custkey % 4000 // 60)::VARCHAR ||
  ':' || lpad((c.c_custkey % 4000 % 60)::VARCHAR, 2, '0') || {_NL} END || '---' || {_NL}
  || CASE WHEN c.c_custkey % 2 = 0 THEN '## Transcript' || {_NL} || lines ELSE '*No subtitles available.*' || {_NL} || CASE WHEN c.c_custkey % 3 = 0
    THEN '' ELSE '## Description' || {_NL} || 'd' || c.c_custkey::VARCHAR || chr(10) END END AS md
FROM customer c JOIN said ON c.c_custkey = said.c_custkey
""")
def transcript_md(spark, sf_dir):
    cues = F.when(_key() % 2 == 0, adapters.vtt_cues(_vtt())).otherwise(adapters.vtt_cues(F.lit("")))
    seconds = F.when(_key() % 5 != 0, _key() % 4000)
    about = F.when(_key() % 3 != 0, F.concat(F.lit("d"), _key().cast("string")))
    return _customers(spark, sf_dir).select("c_custkey", adapters.transcript_markdown(F.col("c_name"), seconds, about, cues).alias("md"))


@catalog.add("""
SELECT c_custkey, 0 AS pos, c_name || ' & <1> "' || (c_custkey % 4)::VARCHAR || '"' AS title, 'https://a.example/?q=' || c_custkey::VARCHAR || '&x'
  AS url FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END, 'Two', 'https://b.example/' || c_custkey::VARCHAR FROM customer
UNION ALL SELECT c_custkey, 1, 'Three', 'https://c.example' FROM customer WHERE c_custkey % 3 = 0
""")
def serp_parse(spark, sf_dir):
    key = _key().cast("string")
    first = F.concat(
        F.lit('<a rel="x" href="//d.example/l/?uddg=https%3A%2F%2Fa.example%2F%3Fq%3D'), key, F.lit('%26x&amp;rut=1" class="result__a"> '), "c_name", F.lit(" &amp; &lt;1&gt; &quot;"), (_key() % 4).cast("string"), F.lit("&quot; </a>"),
    )
    page = F.concat(F.when(_key() % 3 != 0, first).otherwise("<p>none</p>"), F.lit('<a href="/local" class="result__a">No</a><a href="//b.example/'), key, F.lit('" class="result__a">Two</a><a href="//c.example" class="result__a">Three</a>'))
    rows = _customers(spark, sf_dir).select("c_custkey", F.posexplode(adapters.search_results(page, 2)).alias("pos", "r"))
    return rows.select("c_custkey", "pos", "r.title", "r.url")


@catalog.add("""
SELECT c_custkey, 0 AS pos, c_name AS title, 'u' || c_custkey::VARCHAR AS url, '' AS content FROM customer WHERE c_custkey % 4 <> 0
UNION ALL SELECT c_custkey, 1, '2 é', 'v', 'c' FROM customer WHERE c_custkey % 4 IN (1, 2)
""")
def search_json(spark, sf_dir):
    """By key: a missing field makes the whole list unreadable; two of three; two; one."""
    one = F.concat(F.lit('{"title":"'), "c_name", F.lit('","url":"u'), _key().cast("string"), F.lit('","content":""}'))
    two, three = F.lit(',{"title":"2 é","url":"v","content":"c"}'), F.lit(',{"title":"3","url":"w","content":"d"}')
    more = F.when(_key() % 4 == 0, ',{"title":"no url","content":""}').when(_key() % 4 == 1, F.concat(two, three)).when(_key() % 4 == 2, two).otherwise("")
    doc = F.concat(F.lit('{"results":['), one, more, F.lit('],"unresponsive_engines":[]}'))
    rows = _customers(spark, sf_dir).select("c_custkey", F.posexplode(adapters.json_results(doc, 2)).alias("pos", "r"))
    return rows.select("c_custkey", "pos", "r.title", "r.url", "r.content")


@catalog.add("SELECT page_id, len(regexp_extract_all(html, '(?is)<a[ \\t]([^>]*)>(.*?)</a>', 1)) > 0 AS has_links, strlen(html) // 4 AS tokens FROM pages")
def page_profile(spark, sf_dir):
    links = F.size(F.regexp_extract_all("html", F.lit(r"(?is)<a[ \t]([^>]*)>(.*?)</a>"), F.lit(1))) > 0
    return pages(spark, sf_dir).select("page_id", links.alias("has_links"), tokens.estimate(F.col("html")).alias("tokens"))


@catalog.add("""
WITH r AS (SELECT n_regionkey AS query, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS pos, n_name AS title,
  'https://n.example/' || n_nationkey::VARCHAR AS url FROM nation)
SELECT query, string_agg(CASE WHEN pos < 3 THEN '## ' || (pos + 1)::VARCHAR || '. ' || title || chr(10) || url || chr(10) || chr(10) || repeat('z',
  2000) || ' [...]' || chr(10) || chr(10) ELSE (pos + 1)::VARCHAR || '. ' || title || ' — ' || url || chr(10) END, '' ORDER BY pos) AS report FROM r
  WHERE pos < 4 GROUP BY query
""")
def search_report(spark, sf_dir):
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("query"), (F.row_number().over(order) - 1).alias("pos"), F.col("n_name").alias("title"), F.concat(F.lit("https://n.example/"), F.col("n_nationkey").cast("string")).alias("url"), F.repeat(F.lit("z"), F.lit(2500)).alias("content"))
    first = rows.where("query < 3")
    return search.report(search.prefer(first, rows), with_content=True, most=4)
