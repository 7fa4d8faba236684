"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import ship
from corvane.llm import chat, decontamination, importance, licenses, line_dedup, packing, prefix_trie, quality, sharding, simhash, token_files, url_filter, warc
from corvane.llm.common import Workspace
from corvane.llm.encoders import vocabulary

#: Rules of the URL query: verdict, host and path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    read = chat.read_back(chat.format_conversations(rows.unionByName(odd)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op2")
    segments = token_files.token_segments(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), 0)
    return token_files.read_documents(work.write(segments, "segments", "none"))


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op3")
    return warc.read_pages(work.write(warc.archives(table(spark, sf_dir, "pages")), "archives"), work=work)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), 1)[1]


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, model)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op12")
    scores = importance.importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), work)
    return importance.draw(scores, work).select("doc_id", "n_features", "weight", "score", "rank")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), Workspace(spark, "op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_format, op2_token_files, op3_warc_archives, op4_line_dedup, op5_best_fit_packing, op6_sharding, op7_license_scan, op8_quality_rules, op9_simhash, op10_decontamination, op11_url_filters, op12_importance_resampling, op13_prefix_trie)
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, role || text AS both_texts,
    replace(replace(replace(replace(replace(text, '[/INST]', '&#91;/INST]'), '[INST]', '&#91;INST]'), '[role=', '&#91;role='), '</s>', '&lt;/s>'), '<s>', '&lt;s>') AS once,
    replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;') AS fully
  FROM given
), leveled AS (
  SELECT *, CASE
    WHEN contains(both_texts, '&lt;') OR contains(both_texts, '&#91;') OR contains(both_texts, '&#93;') OR contains(both_texts, '&amp;') THEN fully
    WHEN once = text THEN text ELSE once END AS shown
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(7 + length(shown) + CASE WHEN role = 'user' THEN 15 ELSE 8 + length(role) END)::BIGINT AS formatted_chars
FROM leveled GROUP BY conv_id
"""

OP3_SQL = r"""
WITH own AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), last AS (
  SELECT html, max(page_id) AS top FROM own WHERE n >= 1000 GROUP BY html
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(own.html) AS payload_digest,
  CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top > page_id THEN top END AS refers_to
FROM own LEFT JOIN last ON own.html = last.html
"""

OP10_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS m FROM item WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i + 1 : i + m], ' ') AS s FROM sized, unnest(range(len(w) - m + 1)) AS u(i)
), places AS (
  SELECT doc_id, m, i, array_to_string(w[i + 1 : i + m], ' ') AS s FROM doc, (SELECT DISTINCT m FROM windows) AS k, unnest(range(greatest(0, len(w) - m + 1))) AS u(i)
), found AS (
  SELECT DISTINCT doc_id, places.m AS m, i, item_id FROM places JOIN windows ON places.m = windows.m AND places.s = windows.s
), hit AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM found, unnest(range(m)) AS u(j) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY doc_id
)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit ON doc.doc_id = hit.doc_id LEFT JOIN named ON doc.doc_id = named.doc_id
"""


# CRC-32 of bytes, by its table: DuckDB has no such function.
_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS steps FROM range(256) AS r(k))"


def _crc32(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_HEX_BYTES = "list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)"

OP12_SQL = f"""
WITH crc AS {_CRC_TABLE}, doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents
), item AS (
  SELECT {_WORDS} AS ws FROM benchmark
), doc_words AS (
  SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM doc) GROUP BY r, w
), item_words AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM item) GROUP BY w
), vocabulary AS (
  SELECT w, {_crc32(_HEX_BYTES)} % 10000 AS b FROM (SELECT w FROM doc_words UNION SELECT w FROM item_words), crc
), s AS (
  SELECT b, sum(n)::DOUBLE AS s FROM doc_words JOIN vocabulary USING (w) GROUP BY b
), t AS (
  SELECT b, sum(n)::DOUBLE AS t FROM item_words JOIN vocabulary USING (w) GROUP BY b
), gains AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain
  FROM range(10000) AS r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), weights AS (
  SELECT r, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM doc_words JOIN vocabulary USING (w) JOIN gains USING (b) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM doc LEFT JOIN weights USING (r)
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM placed) THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""

OP13_SQL = f"""
WITH crc AS {_CRC_TABLE}, placed AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, list(t ORDER BY p) AS own FROM placed GROUP BY c
), led AS (
  SELECT a.c, a.own, coalesce(b.own, []) AS source,
    (SELECT {_crc32("list_transform(string_split(a.c::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 6 FROM crc) AS h
  FROM convs AS a LEFT JOIN convs AS b ON b.c = a.c - a.c % 100
), rebuilt AS (
  SELECT c, list_concat(source[1:h], own[h + 1:]) AS ts FROM led
), prefixes AS (
  SELECT c, d, md5(to_json(ts[1:d])::VARCHAR) AS k, d = len(ts) AS last, coalesce(length(ts[d].text), 0) AS chars,
    CASE WHEN d > 0 THEN md5(to_json(ts[1:d - 1])::VARCHAR) END AS above
  FROM rebuilt, unnest(range(len(ts) + 1)) AS u(d)
), nodes AS (
  SELECT d, k, min(c) AS c, any_value(above) AS above, any_value(chars) AS chars, count(*) AS n, count(*) FILTER (last) AS n_last,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends
  FROM prefixes GROUP BY d, k
), below AS (
  SELECT DISTINCT a.d, a.k, b.d AS d2, b.k AS k2 FROM prefixes AS a JOIN prefixes AS b ON a.c = b.c AND b.d >= a.d
), sums AS (
  SELECT below.d, below.k, count(*) FILTER (n = n_last) AS n_leaves, sum((n - 1) * chars)::BIGINT AS saved
  FROM below JOIN nodes ON nodes.d = d2 AND nodes.k = k2 GROUP BY below.d, below.k
), children AS (
  SELECT d - 1 AS d, above AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, above
)
SELECT nodes.c AS conv_id, nodes.d AS depth, up.c AS parent_conv_id, nodes.n AS n_convs, coalesce(children.n, 0) AS n_children, n_leaves, saved AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN sums ON nodes.d = sums.d AND nodes.k = sums.k
LEFT JOIN nodes AS up ON up.d = nodes.d - 1 AND up.k = nodes.above
LEFT JOIN children ON children.d = nodes.d AND children.k = nodes.k
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op3_warc_archives": OP3_SQL, "op10_decontamination": OP10_SQL, "op12_importance_resampling": OP12_SQL, "op13_prefix_trie": OP13_SQL}
