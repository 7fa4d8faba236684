"""Queries over fetch logs, route statistics, the content cache and page versions."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from corvane.functions import classify, urls
from corvane.operators import cache, evidence, history, routes
from corvane.plans.base import Catalog, sql_domain, sql_lines
from corvane.plans.page_queries import sql_reason
from corvane.sources import route_files, seeds, store
from corvane.sources.tables import FETCH_LOG_SQL, NOW, PAGE_HISTORY_SQL, URL_CACHE_SQL, fetch_log, now, page_history, table, url_cache

catalog = Catalog()
_LOG = f"WITH log AS ({FETCH_LOG_SQL}), "
_FOLD = "CASE WHEN len(l) = 1 THEN l[1] ELSE list_reduce(l, lambda a, x, i: (a * (i - 1) + x) // i) END"
_STATS = f"""stats AS (
  SELECT domain, strategy, {_FOLD} AS avg_latency_ms, success_rate, total_requests, last_success_at, last_check_at FROM (
    SELECT domain, strategy, list(latency_ms ORDER BY ts, event_id) AS l, avg(success::INT) AS success_rate, count(*)::INT AS total_requests,
      max(CASE WHEN success THEN ts END) AS last_success_at, max(ts) AS last_check_at
    FROM log GROUP BY domain, strategy)
), scored AS (SELECT *, success_rate * (1 / greatest(avg_latency_ms / 1000.0, 0.001)) AS score FROM stats),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, strategy) AS rank FROM scored),
best AS (SELECT * FROM ranked WHERE rank = 1) """


def _stats(spark, sf_dir):
    return routes.route_stats(fetch_log(spark, sf_dir))


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@catalog.add(_LOG + _STATS + "SELECT domain, strategy, avg_latency_ms, round(success_rate, 6) AS success_rate, total_requests, last_success_at, last_check_at FROM stats")
def route_stats_exact(spark, sf_dir):
    return _round(_stats(spark, sf_dir), "success_rate")


@catalog.add(_LOG +
    "x AS (SELECT 1) SELECT domain, strategy, floor(avg(latency_ms))::BIGINT AS avg_latency_ms, count(*)::INT AS total_requests FROM log GROUP BY domain, "
    "strategy"
)
def route_stats_mean(spark, sf_dir):
    return routes.route_stats_mean(fetch_log(spark, sf_dir)).select("domain", "strategy", "avg_latency_ms", "total_requests")


@catalog.add(_LOG + _STATS + "SELECT domain, strategy, avg_latency_ms, round(success_rate, 6) AS success_rate, total_requests FROM stats")
def route_merge(spark, sf_dir):
    log = fetch_log(spark, sf_dir)
    first = log.where("ts < timestamp_ntz'2024-01-15'")
    merged = routes.merge_outcomes(routes.route_stats(first), log.where("ts >= timestamp_ntz'2024-01-15'"))
    return _round(merged, "success_rate").select("domain", "strategy", "avg_latency_ms", "success_rate", "total_requests")


@catalog.add(_LOG + _STATS + "SELECT domain, strategy, round(score, 6) AS score, rank::INT AS rank FROM ranked")
def route_ranking(spark, sf_dir):
    return _round(routes.ranked(_stats(spark, sf_dir)), "score").select("domain", "strategy", "score", "rank")


@catalog.add(_LOG + _STATS + "SELECT domain, strategy, round(score, 6) AS score FROM best")
def route_best(spark, sf_dir):
    return _round(routes.best(_stats(spark, sf_dir)), "score")


_TARGETS = "urls AS (SELECT o_orderkey, 'https://d' || (o_orderkey % 30)::VARCHAR || '.example.com/o' AS url FROM orders) "


def _targets(spark, sf_dir):
    u = F.concat(F.lit("https://d"), (F.col("o_orderkey") % 30).cast("string"), F.lit(".example.com/o"))
    return table(spark, sf_dir, "orders").select("o_orderkey", urls.domain(u).alias("domain"))


@catalog.add(_LOG + _STATS + ", " + _TARGETS +
    f"SELECT o_orderkey, u.domain, b.strategy IS NOT NULL AS known, coalesce(b.strategy, 'HttpSimple') AS strategy, round(b.score, 6) AS score FROM (SELECT "
    f"o_orderkey, {sql_domain('url')} AS domain FROM urls) u LEFT JOIN best b ON u.domain = b.domain"
)
def route_resolve(spark, sf_dir):
    return _round(routes.resolve(_targets(spark, sf_dir), _stats(spark, sf_dir)), "score")


_PROBES = "probes AS (SELECT 'd' || (event_id % 40)::VARCHAR || '.example.com' AS domain, strategy, CASE WHEN success THEN status END AS status, latency_ms FROM log) "
_WINNER = f"""winner AS (
  SELECT d.domain, coalesce(w.strategy, 'HttpSimple') AS strategy, coalesce(w.latency_ms, 5000) AS latency_ms, w.strategy IS NOT NULL AS success FROM
    (SELECT DISTINCT domain FROM probes) d LEFT JOIN (
    SELECT domain, strategy, latency_ms, row_number() OVER (PARTITION BY domain ORDER BY latency_ms, list_position({list(routes.PROBED)!r}, strategy)) AS k FROM probes
    WHERE strategy IN ('HttpSimple', 'TlsChrome', 'TlsMobile', 'Headless') AND status NOT IN (403, 503)) w ON d.domain = w.domain AND k = 1) """


def _probes(spark, sf_dir):
    log = fetch_log(spark, sf_dir)
    return log.select(F.concat(F.lit("d"), (F.col("event_id") % 40).cast("string"), F.lit(".example.com")).alias("domain"), "strategy", F.when(F.col("success"), F.col("status")).alias("status"), "latency_ms")


@catalog.add(_LOG + _PROBES + ", " + _WINNER + "SELECT * FROM winner")
def probe_winner(spark, sf_dir):
    return routes.probe_winner(_probes(spark, sf_dir))


@catalog.add(_LOG + _STATS + ", " + _PROBES + ", " + _WINNER + ", " + _TARGETS + f"""
, t AS (SELECT o_orderkey, {sql_domain('url')} AS domain, CASE WHEN o_orderkey % 7 = 0 THEN 'TlsMobile' END AS explicit FROM urls)
SELECT o_orderkey, explicit IS NOT NULL OR b.strategy IS NOT NULL OR w.strategy IS NOT NULL AS known, coalesce(explicit, b.strategy, w.strategy,
  'HttpSimple') AS strategy,
  round(CASE WHEN explicit IS NOT NULL THEN 1.0 WHEN b.strategy IS NOT NULL THEN b.score WHEN w.strategy IS NOT NULL THEN 0.5 END, 6) AS score FROM t
    LEFT JOIN best b ON t.domain = b.domain LEFT JOIN winner w ON t.domain = w.domain
""")
def route_resolve_probing(spark, sf_dir):
    t = _targets(spark, sf_dir).withColumn("explicit", F.when(F.col("o_orderkey") % 7 == 0, F.lit("TlsMobile")))
    out = routes.resolve_with_probes(t, _stats(spark, sf_dir), routes.probe_winner(_probes(spark, sf_dir)))
    return _round(out, "score").select("o_orderkey", "known", "strategy", "score")


@catalog.add(_LOG + _STATS +
    f"SELECT domain, strategy, total_requests FROM stats WHERE NOT (total_requests >= 80 AND success_rate < 0.75 AND last_check_at < TIMESTAMP '{NOW}' - "
    f"INTERVAL 30 DAY)"
)
def route_evict_stale(spark, sf_dir):
    return routes.evict_stale(_stats(spark, sf_dir), 80, 0.75, 30, now()).select("domain", "strategy", "total_requests")


@catalog.add(_LOG + _STATS + "SELECT domain, strategy, last_check_at FROM stats ORDER BY last_check_at DESC, domain, strategy LIMIT 50")
def route_capacity(spark, sf_dir):
    return routes.evict_over_capacity(_stats(spark, sf_dir), 50).select("domain", "strategy", "last_check_at")


@catalog.add(_LOG +
    "x AS (SELECT *, event_type = 'view' AS is_spa FROM log) SELECT domain, strategy, count(*) AS n, sum((status < 400)::INT)::BIGINT AS ok FROM x WHERE "
    "NOT (is_spa AND strategy <> 'Headless') GROUP BY domain, strategy"
)
def route_recorded(spark, sf_dir):
    rows = routes.recordable(fetch_log(spark, sf_dir).withColumn("is_spa", F.col("event_type") == "view"))
    return rows.groupBy("domain", "strategy").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("success").cast("long")).alias("ok"))


@catalog.add(_LOG +
    "x AS (SELECT 1) SELECT count(DISTINCT domain) AS domains, count(DISTINCT domain || ' ' || strategy) AS routes FROM log WHERE domain <> "
    "'d3.example.com'"
)
def route_counts(spark, sf_dir):
    kept = routes.remove(fetch_log(spark, sf_dir), "d3.example.com")
    return kept.agg(F.countDistinct("domain").alias("domains"), F.countDistinct("domain", "strategy").alias("routes"))


@catalog.add(_LOG + """x AS (SELECT 1) SELECT event_id, CASE WHEN success THEN 'Transient' WHEN status = 429 THEN 'RateLimited' WHEN status IN (403, 503) THEN 'Blocking' ELSE 'NotFound' END AS error_class,
  CASE WHEN status IN (403, 503) THEN 'Blocked' ELSE 'Accessible' END AS probe, coalesce(list_position(['HttpSimple','TlsChrome','TlsMobile','Headless','PublicApi','YouTube'], strategy), 0) - 1 AS rank FROM log""")
def error_class(spark, sf_dir):
    log = fetch_log(spark, sf_dir)
    kind = F.when(F.col("success"), "timeout").otherwise("http")
    return log.select("event_id", classify.error_class(kind, F.col("status")).alias("error_class"), classify.probe_result(F.col("status"), F.lit(None).cast("string"))["kind"].alias("probe"), routes.fallback_rank(F.col("strategy")).cast("int").alias("rank"))


@catalog.add("""
SELECT c_custkey, [200, 206, 301, 302, 307, 308, 403, 503, 404, 500][(c_custkey % 10 + 1)::INT] AS status,
  ['Accessible','Accessible','Redirect','Redirect','Redirect','Redirect','Blocked','Blocked','Accessible','Accessible'][(c_custkey % 10 + 1)::INT] AS
  kind,
  CASE WHEN c_custkey % 10 BETWEEN 2 AND 5 THEN CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/to' END END AS location FROM customer
""")
def probe_class(spark, sf_dir):
    i = F.col("c_custkey")
    status = F.get(F.array(*map(F.lit, (200, 206, 301, 302, 307, 308, 403, 503, 404, 500))), (i % 10).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", status.alias("status"))
    return rows.select("c_custkey", "status", classify.probe_result(F.col("status"), F.when(i % 3 != 0, F.lit("/to"))).alias("p")).select("c_custkey", "status", "p.kind", "p.location")


_ORDER = "['HttpSimple','TlsChrome','TlsMobile','Headless','PublicApi','YouTube']"


@catalog.add(f"""
WITH t AS (SELECT c_custkey, (c_custkey % 6)::INT AS r, {_ORDER}[(c_custkey % 6 + 1)::INT] AS current, [{_ORDER}[(c_custkey % 6 + 1)::INT],
  {_ORDER}[(c_custkey * 7 % 5 + 1)::INT]] AS visited, (c_custkey % 4)::INT AS attempts, CASE WHEN c_custkey % 11 = 0 THEN 'NotFound' ELSE 'Blocking'
  END AS class FROM customer)
SELECT c_custkey, CASE WHEN attempts >= 3 OR class = 'NotFound' THEN NULL ELSE list_filter({_ORDER}[r + 2:6], lambda x: NOT list_contains(visited,
  x))[1] END AS next FROM t
""")
def fallback_next(spark, sf_dir):
    i, names = F.col("c_custkey"), F.array(*map(F.lit, routes.STRATEGIES))
    current = F.get(names, (i % 6).cast("int"))
    visited = F.array(current, F.get(names, (i * 7 % 5).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", routes.next_strategy(current, visited, F.when(i % 11 == 0, "NotFound").otherwise("Blocking"), (i % 4).cast("int")).alias("next"))


_OUTCOMES = f"""WITH RECURSIVE outcomes AS (
  SELECT p_partkey AS url, unnest({_ORDER}) AS strategy, unnest(range(6)) AS r FROM part
), o AS (
  SELECT url, strategy, r, CASE (url * 31 + r * 17) % 7 WHEN 0 THEN 'Transient' WHEN 1 THEN 'Blocking' WHEN 2 THEN 'NotFound' WHEN 3 THEN
    'RateLimited' END AS error, (url + r) % 5 = 0 AS spa, (url * 13 + r * 5) % 4 < 2 AS good FROM outcomes
), loop AS (
  SELECT p_partkey AS url, {_ORDER}[(p_partkey % 3 + 1)::INT] AS current, []::VARCHAR[] AS visited, 0 AS attempts, NULL::VARCHAR AS result FROM part
  UNION ALL
  SELECT url, CASE WHEN result IS NULL THEN following ELSE current END, visited, attempts, result FROM (
    SELECT url, current, visited, attempts, following, CASE WHEN error IS NULL AND good THEN 'ok' WHEN following IS NULL THEN CASE WHEN error IN
      ('NotFound', 'RateLimited') THEN 'error:' || error WHEN error IS NULL THEN 'low-quality' ELSE 'exhausted' END WHEN attempts >= 3 THEN
      'exhausted' END AS result FROM (
      SELECT *, CASE WHEN error IN ('NotFound', 'RateLimited') THEN NULL WHEN error IS NULL AND spa AND NOT list_contains(visited, 'Headless') THEN
        'Headless' WHEN attempts >= 3 THEN NULL ELSE list_filter({_ORDER}[r + 2:6], lambda x: NOT list_contains(visited, x))[1] END AS following FROM
        (
        SELECT loop.url, current, list_append(visited, current) AS visited, attempts + 1 AS attempts, error, spa, good, r FROM loop JOIN o ON
          loop.url = o.url AND loop.current = o.strategy WHERE result IS NULL)))
)
SELECT url, visited[len(visited)] AS strategy, attempts, result, array_to_string(visited, ',') AS visited FROM loop WHERE result IS NOT NULL
"""


@catalog.add(_OUTCOMES)
def fallback_replay(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"))
    names = F.array(*map(F.lit, routes.STRATEGIES))
    o = part.select("url", F.posexplode(names).alias("r", "strategy"))
    u, r = F.col("url"), F.col("r")
    error = F.get(F.array(*map(F.lit, ("Transient", "Blocking", "NotFound", "RateLimited"))), ((u * 31 + r * 17) % 7).cast("int"))
    o = o.select("url", "strategy", error.alias("error_class"), ((u + r) % 5 == 0).alias("is_spa"), ((u * 13 + r * 5) % 4 < 2).alias("valuable"))
    return routes.replay(part.select("url", F.get(names, (u % 3).cast("int")).alias("strategy")), o)


_SEEDED_DOMAIN = f"CASE WHEN event_id % 40 < 20 THEN domain ELSE {[d for d, _ in seeds.seed_rows()]}[(event_id % 40 + 1)::INT] END"


@catalog.add(
    _LOG + "s(domain, strategy) AS (VALUES " + ", ".join(f"('{d}', '{s}')" for d, s in seeds.seed_rows()) + f"""), known AS (
  SELECT {_SEEDED_DOMAIN} AS domain, strategy, count(*)::INT AS total_requests, avg(success::INT::DOUBLE) AS success_rate, max(ts) AS last_check_at FROM log GROUP BY 1, 2
)
SELECT * FROM known UNION ALL SELECT domain, strategy, 1, 1.0::DOUBLE, TIMESTAMP '1970-01-01' FROM s WHERE domain NOT IN (SELECT domain FROM known)"""
)
def route_seeds(spark, sf_dir):
    """Seeds for their domains that the log has no route of."""
    k, names = F.col("event_id") % 40, F.array(*[F.lit(d) for d, _ in seeds.seed_rows()])
    log = fetch_log(spark, sf_dir).withColumn("domain", F.when(k < 20, F.col("domain")).otherwise(F.get(names, k.cast("int"))))
    return seeds.seed_missing(routes.route_stats_mean(log)).select("domain", "strategy", "total_requests", "success_rate", "last_check_at")


@catalog.add(_LOG + _STATS + """, e AS (SELECT * FROM stats WHERE strategy IN ('Headless', 'YouTube'))
SELECT domain, strategy, avg_latency_ms, total_requests FROM stats WHERE strategy NOT IN ('Headless', 'YouTube') UNION ALL SELECT domain, strategy,
  avg_latency_ms + 1, total_requests FROM e
UNION ALL SELECT 'new.example.com', 'TlsChrome', 10, 1""")
def route_import_replace(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    changed = stats.where("strategy in ('Headless', 'YouTube')").select("domain", "strategy", (F.col("avg_latency_ms") + 1).alias("avg_latency_ms"), "success_rate", "total_requests")
    new = spark.createDataFrame([("new.example.com", "TlsChrome", 10, 1.0, 1)], changed.schema)
    return route_files.replace_stats(stats, changed.unionByName(new), now()).select("domain", "strategy", "avg_latency_ms", "total_requests")


@catalog.add(_LOG + _STATS +
    ", e AS (SELECT * FROM stats) SELECT e.domain, e.strategy, (s.avg_latency_ms * s.total_requests + e.avg_latency_ms) // (s.total_requests + 1) AS "
    "avg_latency_ms, s.total_requests + 1 AS total_requests FROM e JOIN stats s ON e.domain = s.domain AND e.strategy = s.strategy"
)
def route_import_merge(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    return routes.merge_outcomes(stats, route_files.as_outcomes(stats, now())).select("domain", "strategy", "avg_latency_ms", "total_requests")


@catalog.add(_LOG + _STATS + "SELECT domain, strategy, avg_latency_ms, round(success_rate, 6) AS success_rate, total_requests FROM stats")
def route_export(spark, sf_dir):
    """Routes as one JSON array, read back."""
    text = route_files.export_text(_stats(spark, sf_dir))
    entries = text.select(F.explode(F.from_json("json", f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in route_files.ENTRY.split(', '))}>>")).alias("e")).select("e.*")
    return _round(entries, "success_rate")


@catalog.add("""
SELECT 'n' || n_nationkey::VARCHAR || '.example' AS domain, ['HttpSimple','TlsChrome','Headless'][(n_nationkey % 3 + 1)::INT] AS strategy, 0::BIGINT
  AS avg_latency_ms, 1.0::DOUBLE AS success_rate,
  CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 1 END AS total_requests FROM nation
""")
def route_pack(spark, sf_dir):
    """Packs of a region each; some nations are in a second pack, too."""
    k = F.col("n_nationkey")
    entry = F.struct(F.concat(F.lit("n"), k.cast("string"), F.lit(".example")).alias("domain"), F.get(F.array(*map(F.lit, ("HttpSimple", "TlsChrome", "Headless"))), (k % 3).cast("int")).alias("strategy"))
    nations = table(spark, sf_dir, "nation")
    packs = nations.groupBy("n_regionkey").agg(F.collect_list(entry).alias("domains")).select("domains")
    more = nations.where(k % 4 == 0).select(F.array(entry).alias("domains"))
    return routes.route_stats(route_files.pack_outcomes(packs.unionByName(more), now())).select("domain", "strategy", "avg_latency_ms", "success_rate", "total_requests")


# --- content cache ---

_CACHE = f"WITH cache AS ({URL_CACHE_SQL}) "


@catalog.add(_CACHE + """, later AS (SELECT url, strategy, extraction_mode, content || ' again' AS content, TIMESTAMP '2024-06-01 00:00:00' AS created_at FROM cache WHERE doc_id % 5 = 0 AND strlen(content || ' again') <= 102400)
SELECT c.url, c.strategy, sha256(coalesce(l.content, c.content)) AS content_hash, coalesce(l.created_at, c.created_at) AS created_at, CASE WHEN l.url IS NULL THEN c.expires_at ELSE l.created_at + INTERVAL 1 HOUR END AS expires_at FROM cache c LEFT JOIN later l ON c.url = l.url AND c.strategy = l.strategy""")
def cache_upsert(spark, sf_dir):
    c = url_cache(spark, sf_dir)
    later = c.where(F.substring_index("url", "/", -1).cast("long") % 5 == 0).select("url", "strategy", "extraction_mode", F.concat("content", F.lit(" again")).alias("content"), "content_type", F.lit("2024-06-01").cast("timestamp_ntz").alias("created_at"))
    return cache.put(c, later, 3600).select("url", "strategy", "content_hash", "created_at", "expires_at")


@catalog.add(_CACHE + """
SELECT url, strategy, CASE WHEN doc_id % 5 = 0 AND strlen(content) + 6 <= 102400 THEN 'links' ELSE extraction_mode END AS extraction_mode,
  CASE WHEN doc_id % 5 = 0 AND strlen(content) + 6 <= 102400 THEN sha256(content || ' links') ELSE content_hash END AS content_hash FROM cache
""")
def cache_upsert_strict(spark, sf_dir):
    """Without the mode in the key an entry of another mode takes the place of the first."""
    c = url_cache(spark, sf_dir)
    later = c.where(F.substring_index("url", "/", -1).cast("long") % 5 == 0).select("url", "strategy", F.lit("links").alias("extraction_mode"), F.concat("content", F.lit(" links")).alias("content"), "content_type", F.lit("2024-06-01").cast("timestamp_ntz").alias("created_at"))
    return cache.put(c, later, 3600, strict_parity=True).select("url", "strategy", "extraction_mode", "content_hash")


@catalog.add(_CACHE + "SELECT 'before' AS state, count(*) AS entry_count, coalesce(sum(original_size), 0)::BIGINT AS total_size_bytes FROM cache UNION ALL SELECT 'after', 0, 0")
def cache_clear(spark, sf_dir):
    """What a cache holds before and after it is cleared."""
    c = url_cache(spark, sf_dir)
    return cache.stats(c).select(F.lit("before").alias("state"), "*").unionByName(cache.stats(cache.clear(c)).select(F.lit("after").alias("state"), "*"))


@catalog.add(_CACHE + """
SELECT url, CASE WHEN doc_id % 4 < 2 THEN 'HttpSimple' ELSE strategy END AS strategy, 'markdown' AS extraction_mode, content_hash, original_size, expires_at,
  CASE WHEN doc_id % 4 > 0 THEN '"' || left(content_hash, 8) || '"' END AS etag FROM cache
""")
def store_migrations(spark, sf_dir):
    """A cache whose rows were written in four schema versions, read as one."""
    c, k = url_cache(spark, sf_dir), F.substring_index("url", "/", -1).cast("long") % store.CURRENT
    parts = [store.upgrade(c.where(k == v - 1).select(*store.columns_of("cache", v)), "cache", v) for v in range(1, store.CURRENT + 1)]
    whole = functools.reduce(lambda a, b: a.unionByName(b), parts)
    return whole.select("url", "strategy", "extraction_mode", "content_hash", "original_size", "expires_at", "etag")


@catalog.add(_CACHE + "SELECT url, content_hash, true AS smaller FROM cache WHERE original_size > 2000")
def cache_gzip(spark, sf_dir):
    """Contents compressed and read back."""
    c = url_cache(spark, sf_dir).where("original_size > 2000").select("url", "original_size", route_files.gzip_bytes("content").alias("z"))
    return c.select("url", F.sha2(route_files.gunzip_text("z"), 256).alias("content_hash"), (F.octet_length("z") < F.col("original_size")).alias("smaller"))


@catalog.add(_CACHE +
    f"SELECT url, strategy, content_hash, epoch(TIMESTAMP '{NOW}' - created_at)::BIGINT AS age_seconds FROM cache WHERE doc_id % 2 = 0 AND expires_at > "
    f"TIMESTAMP '{NOW}'"
)
def cache_get(spark, sf_dir):
    c = url_cache(spark, sf_dir)
    keys = c.where(F.substring_index("url", "/", -1).cast("long") % 2 == 0).select("url", "strategy")
    return cache.get(c, keys, now()).select("url", "strategy", "content_hash", "age_seconds")


_BY_SOURCE = ", s AS (SELECT 'https://' || split_part(url, '/', 3) || '/' || (doc_id % 50)::VARCHAR AS url, strategy, content_hash, created_at, expires_at FROM cache) "


def _by_source(spark, sf_dir):
    c = url_cache(spark, sf_dir)
    page = (F.substring_index("url", "/", -1).cast("long") % 50).cast("string")
    return c.withColumn("url", F.concat(F.lit("https://"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/"), page))


@catalog.add(_CACHE + _BY_SOURCE +
    f"SELECT url, strategy, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY created_at DESC, strategy DESC) AS k FROM s) WHERE k "
    f"= 1 AND expires_at > TIMESTAMP '{NOW}'"
)
def cache_get_any(spark, sf_dir):
    return cache.get_any(_by_source(spark, sf_dir), now()).select("url", "strategy", "content_hash")


@catalog.add(_CACHE + f"SELECT url, strategy FROM cache WHERE {sql_reason('content')} IS NULL")
def cache_validated(spark, sf_dir):
    return cache.validated(url_cache(spark, sf_dir)).select("url", "strategy")


@catalog.add(_CACHE +
    ", t AS (SELECT greatest(last_accessed_at, TIMESTAMP '2024-02-01 00:00:00') AS a FROM cache) SELECT min(a) AS first_at, max(a) AS last_at, count(*) AS "
    "n FROM t"
)
def cache_touch(spark, sf_dir):
    c = url_cache(spark, sf_dir)
    reads = c.select("url", "strategy", F.lit("2024-02-01").cast("timestamp_ntz").alias("access_ts"))
    return cache.touch(c, reads).agg(F.min("last_accessed_at").alias("first_at"), F.max("last_accessed_at").alias("last_at"), F.count(F.lit(1)).alias("n"))


@catalog.add(_CACHE + "SELECT url, strategy FROM cache WHERE NOT (url ILIKE 'http://src1%' OR url ILIKE 'https://src1%')")
def cache_clear_domain(spark, sf_dir):
    return cache.clear_domain(url_cache(spark, sf_dir), "src1", strict=False).select("url", "strategy")


@catalog.add(_CACHE + "SELECT url, strategy FROM cache WHERE coalesce(nullif(regexp_extract(url, '^https?://([^/:]*)', 1), ''), '') <> 'src1.example.com'")
def cache_clear_domain_strict(spark, sf_dir):
    return cache.delete(url_cache(spark, sf_dir), domain="src1.example.com").select("url", "strategy")


@catalog.add(_CACHE + f"SELECT url, strategy FROM cache WHERE NOT created_at < TIMESTAMP '{NOW}' - INTERVAL 40 DAY AND expires_at > TIMESTAMP '{NOW}'")
def cache_clear_older(spark, sf_dir):
    return cache.drop_expired(cache.clear_older_than(url_cache(spark, sf_dir), 40 * 86400, now()), now()).select("url", "strategy")


@catalog.add(_CACHE + """, t AS (SELECT sum(original_size) AS total FROM cache), w AS (SELECT url, strategy, original_size, sum(original_size) OVER (ORDER BY last_accessed_at, url, strategy ROWS UNBOUNDED PRECEDING) - original_size AS freed FROM cache)
SELECT url, strategy FROM w, t WHERE freed >= total - 1000000""")
def cache_lru_evict(spark, sf_dir):
    return cache.evict_lru(url_cache(spark, sf_dir), 1_000_000).select("url", "strategy")


@catalog.add(_CACHE + "SELECT count(DISTINCT url) AS entry_count, coalesce(sum(original_size), 0)::BIGINT AS total_size_bytes FROM cache")
def cache_stats(spark, sf_dir):
    return cache.stats(url_cache(spark, sf_dir))


@catalog.add(_CACHE +
    "SELECT count(*) AS entry_count, coalesce(sum(original_size), 0)::BIGINT AS total_size_bytes, min(created_at) AS oldest_at, max(created_at) AS "
    "newest_at FROM cache"
)
def cache_detailed(spark, sf_dir):
    return cache.detailed_stats(url_cache(spark, sf_dir))


@catalog.add(_CACHE + f"SELECT {sql_domain('url')} AS domain, count(*) AS n FROM cache GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def cache_top_domains(spark, sf_dir):
    return cache.top_domains(url_cache(spark, sf_dir), 10)


@catalog.add(_CACHE + "SELECT url, strategy, created_at FROM cache WHERE url ILIKE '%P/1%' ORDER BY created_at DESC, url, strategy LIMIT 100")
def cache_search(spark, sf_dir):
    return cache.search(url_cache(spark, sf_dir), "P/1", 500).select("url", "strategy", "created_at")


@catalog.add(_CACHE +
    "SELECT content_hash, url, strategy FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY last_accessed_at DESC, url, strategy) AS k "
    "FROM cache) WHERE k = 1"
)
def cache_dedup(spark, sf_dir):
    return cache.dedup(url_cache(spark, sf_dir)).select("content_hash", "url", "strategy")


@catalog.add(_CACHE + "SELECT url, strategy, doc_id % 3 <> 0 AS unchanged, content_hash AS old_hash FROM cache")
def cache_unchanged(spark, sf_dir):
    c = url_cache(spark, sf_dir)
    again = F.when(F.substring_index("url", "/", -1).cast("long") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return cache.unchanged(c, c.select("url", "strategy", again.alias("content"))).select("url", "strategy", "unchanged", "old_hash")


@catalog.add(_CACHE +
    ", k AS (SELECT url, strategy FROM cache UNION ALL SELECT 'https://none.example', 'HttpSimple') SELECT k.url, k.strategy, '\"' || left(content_hash, "
    "8) || '\"' AS etag, CASE WHEN doc_id % 2 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' END AS last_modified FROM k LEFT JOIN cache c ON k.url = c.url AND "
    "k.strategy = c.strategy"
)
def cache_conditional_headers(spark, sf_dir):
    c = url_cache(spark, sf_dir)
    keys = c.select("url", "strategy").unionByName(spark.createDataFrame([("https://none.example", "HttpSimple")], "url string, strategy string"))
    return cache.conditional_headers(c, keys)


@catalog.add(_CACHE +
    "SELECT 'Route cache: 7 entries' || chr(10) || 'Content cache: ' || count(DISTINCT url)::VARCHAR || ' entries (' || "
    "sum(original_size)::BIGINT::VARCHAR || ' bytes)' AS text FROM cache"
)
def cache_status(spark, sf_dir):
    s = cache.stats(url_cache(spark, sf_dir))
    return s.select(cache.status_text(F.lit(7), F.col("entry_count"), F.col("total_size_bytes")).alias("text"))


# --- page versions ---

_HISTORY = f"WITH history AS ({PAGE_HISTORY_SQL}) "


@catalog.add(_HISTORY +
    "SELECT url, id, rank::INT AS rank FROM (SELECT url, id, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, id DESC) AS rank FROM history) "
    "WHERE rank <= 10"
)
def history_prune(spark, sf_dir):
    return history.newest(page_history(spark, sf_dir)).select("url", "id", "rank")


@catalog.add(_HISTORY + f""", v AS (SELECT url, id, content_hash AS new_hash, lag(content_hash) OVER w AS old_hash, content_body AS b, lag(content_body) OVER w AS o FROM history WINDOW w AS (PARTITION BY url ORDER BY fetched_at, id)),
l AS (SELECT *, {sql_lines('b')} AS n, CASE WHEN o IS NULL THEN NULL ELSE {sql_lines('o')} END AS p FROM v),
d AS (SELECT *, list_filter(n, lambda x: NOT list_contains(p, x)) AS a, list_filter(p, lambda x: NOT list_contains(n, x)) AS r FROM l)
SELECT url, id, old_hash, new_hash, CASE WHEN o IS NULL THEN 0 ELSE len(a) END AS added_lines, CASE WHEN o IS NULL THEN 0 ELSE len(r) END AS
  removed_lines, CASE WHEN o IS NULL THEN 0 ELSE len(n) - len(a) END AS unchanged_lines,
  CASE WHEN o IS NULL OR greatest(len(n), len(p)) = 0 THEN 100.0 ELSE round((len(n) - len(a)) / greatest(len(n), len(p)) * 100, 2) END AS similarity_percent,
  CASE WHEN o IS NULL THEN '' ELSE array_to_string(list_concat(list_transform(a, lambda x: '+ ' || x || chr(10)), list_transform(r, lambda x: '- ' || x || chr(10))), '') END AS diff_text FROM d""")
def page_diff(spark, sf_dir):
    return history.diffs(page_history(spark, sf_dir))


_ISO = "strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ')"


def _evidence(spark, sf_dir):
    h = page_history(spark, sf_dir)
    rows = h.select("id", evidence.bundle(F.col("content_body"), F.col("url"), F.lit("HttpSimple"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(False)).alias("e"))
    rows = rows.select("id", "e.*")
    old = rows.where("id % 2 = 0")
    return evidence.append(old, rows.where("id % 2 = 1").drop("id"))


_EVIDENCE = _HISTORY + f""", e AS (
  SELECT id, url, content_hash FROM history WHERE id % 2 = 0
  UNION ALL SELECT (SELECT max(id) FROM history WHERE id % 2 = 0) + row_number() OVER (ORDER BY {_ISO}, url, content_hash), url, content_hash FROM
    history WHERE id % 2 = 1
) """


@catalog.add(_EVIDENCE + "SELECT id, url, content_hash FROM e")
def evidence_append(spark, sf_dir):
    return _evidence(spark, sf_dir).select("id", "url", "content_hash")


@catalog.add(_EVIDENCE + "SELECT url, id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS k FROM e) WHERE k = 1")
def evidence_latest(spark, sf_dir):
    return evidence.latest(_evidence(spark, sf_dir)).select("url", "id", "content_hash")
