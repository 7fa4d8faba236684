"""URL filters, importance resampling and the prefix trie against plain versions, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import importance, prefix_trie, queries, url_filter
from corvane.llm.common import Workspace

# --- URL filters ---

URLS = [
    "http://ththre.example.com/fr/825?page=2", "https://A.Example.ORG/es/1", "https://example.org/es", "https://x.example.org/en/1", "https://x.example.org/en/25#a", "https://notexample.org/es/2",
    "https://org/a", "https://org", "ftp://com/de/1://x", "https://a.com/de/", "https://a.com/De/", "//a.com/de/", "no scheme", "", None, "://", ":///x", "http://h?q=://", "http://h#/fr/", "HTTPS://U:P@É.Com:80/fr/é?x",
    "http://example.org\n.com/fr/\nx#\n", "http://a.com/fr/" + "long/" * 20_000, "http://casino-bets.example.net/en/1", "http://casino-bets.example.net/en/1",
]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fitting = []
    for verdict, rule in rules:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(_ + tail):
            fitting.append((len(rule), rule, verdict))
    return max(fitting)[1:] if fitting else (None, None)


def plain_grams(host, path):
    out = Counter()
    for kind, part in (("host", host), ("path", path)):
        if part:
            marked = "^" + re.sub("[1-9]", "0", part) + "$"
            for n in url_filter.GRAMS:
                for i in range(len(marked) - n + 1):
                    out[xxhash.xxh64_intdigest(marked[i : i + n].encode(), xxhash.xxh64_intdigest(kind.encode(), 42))] += 1
    return out


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


def test_urls_against_plain_rules_and_scores(spark, model):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, score int")
    found = url_filter.judge_urls(df, queries.URL_RULES, model).collect()
    assert len(found) == len(URLS)
    for row in found:
        host, path = plain_url(URLS[row.page_id])
        rule, verdict = plain_rule(host, path, queries.URL_RULES)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        signed = {k - (1 << 64) * (k >> 63): n for k, n in plain_grams(host, path).items()}
        margin = model[1] + sum(n * model[0][k % len(model[0])] for k, n in signed.items())
        assert math.isclose(row.score, 1 / (1 + math.exp(-max(-700, margin))), rel_tol=1e-6, abs_tol=1e-9)
        assert row.verdict == (verdict or ("block" if row.score >= 0.5 else "allow"))


def test_rules_longest_wins_and_none(spark, model):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rng = random.Random(3)
    hosts = ["org", "example.org", "x.example.org", "com", "a.com", "b.a.com"]
    rules = list({r: (rng.choice(["allow", "block"]), r) for r in (rng.choice(hosts) + rng.choice(["/", "/es/", "/en/1", "/fr/", "/fr/lo", "/de", ""]) for _ in range(40))}.values())
    for row in url_filter.judge_urls(df, rules, model).collect():
        assert row.rule == plain_rule(*plain_url(URLS[row.page_id]), rules)[0]
    assert {r.rule for r in url_filter.judge_urls(df, [], model).collect()} == {None}
    assert url_filter.judge_urls(df.limit(0), rules, model).count() == 0


def test_regression_on_held_out_words(spark, model):
    """Hosts joined of two words that the labelled table never has together, in other forms."""
    rng, rows = random.Random(8), []
    for label, known in ((1, url_filter.BLOCKED_WORDS), (0, url_filter.ALLOWED_WORDS)):
        for i in range(200):
            a, b = rng.sample(known, 2)
            rows.append((i, label, f"https://{a}.{b}{rng.choice(['.com', '.net', '.org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(1, 9999)}"))
    df = spark.createDataFrame(rows, "page_id long, label int, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    right = df.where((url_filter.block_score(host, path, model) >= 0.5).cast("int") == F.col("label")).count()
    assert right / len(rows) >= 0.95


def test_url_query_uses_no_python_worker(spark, tmp_path):
    spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = queries.op11_url_filters(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan) and df.count() == len(URLS)
    blocked = {URLS[r.page_id] for r in df.collect() if r.verdict == "block"}
    assert "http://casino-bets.example.net/en/1" in blocked and None not in blocked


# --- importance resampling ---

TEXTS = ["", None, "   \n", "one", "Über Über 漢字 x", "rain hill " * 30_000, "a\x00b\tc-d_e" * 9, "UPPER Case ÀÉ words of rain"]


def document_rows(n=120):
    rng = random.Random(11)
    out = [(i, " ".join(rng.choice("rain hill stone bird wall low near every sings of the".split()) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    out += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [out[5]] * 9 + [(7, "another text of a repeated id " * 6), (None, "no id " * 15), (None, None), (-5, "stone wall " * 12)]
    return out


def plain_scores(docs, target, max_words):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in range(1, max_words + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    n_s, n_t, out = sum(s.values()), sum(t.values()), []
    for doc_id, text in docs:
        words, b = grams(text)
        w = sum(math.floor(1000 * math.log((t[x] + 1) * (n_s + 10000) / ((s[x] + 1) * (n_t + 10000)))) for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(b), len(words), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("max_words", [1, 3])
def test_importance_against_plain(spark, max_words):
    docs, target = document_rows(), ["rain of the hill", None, "", "stone bird sings"]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, row int, part int").repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    work = Workspace(spark, "test12")
    rows = importance.draw(importance.importance_scores(df, items, work, max_words=max_words), work).collect()
    expected = plain_scores(docs, target, max_words)
    assert Counter((r.doc_id, r.n_features, r.n_words, r.weight, r.score) for r in rows) == Counter(expected)
    able = sorted((-s, d is None, d or 0) for d, _, n, _, s in expected if n >= 20)
    drawn = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in rows if r["rank"] is not None)
    assert [r[0] for r in drawn] == list(range(1, len(able) * 10 // 100 + 1))
    assert [r[1:] for r in drawn] == able[: len(drawn)]


def test_importance_of_small_and_empty_tables(spark):
    work = Workspace(spark, "test12e")
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("rain",)], "text string")
    assert importance.draw(importance.importance_scores(none, items, work), work).count() == 0
    few = spark.createDataFrame([(i, "rain " * 20) for i in range(9)], "doc_id long, text string")
    assert [r["rank"] for r in importance.draw(importance.importance_scores(few, items.limit(0), work), work).collect()] == [None] * 9
    assert importance.draw(importance.importance_scores(few, items, work), work, share=100, min_words=0).where("rank is not null").count() == 9


def test_resample_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(*r, "kept") for r in document_rows()], "doc_id long, text string, rank string")
    items = spark.createDataFrame([("rain of the hill",)], "text string")
    out = importance.resample(df, items, Workspace(spark, "test12r"), share=30)
    assert out.columns == df.columns and 20 < out.count() < 60


# --- prefix trie ---


def conversation_rows(seed=1):
    rng = random.Random(seed)
    turns = [("system", "be kind"), ("user", "hello"), ("user", "ask é🙂"), ("assistant", "reply " * 20), ("assistant", ""), ("user", None), (None, "x")]
    out = []
    for c in [*range(0, 12), *range(100, 130), 205, 206, 305, -7, -100]:
        for k in range(rng.randint(1, 8)):
            role, text = turns[k % 3] if rng.random() < 0.7 else rng.choice(turns)
            out.append((c, k, role, text))
    out += [(1, None, "user", "null turn"), (1, None, "user", "another null turn"), (2, 1, "user", "tie"), (2, 1, "assistant", "tie"), out[3], out[3], (None, 0, "user", "no conversation"), (None, None, None, None)]
    out += [(400, k, "user" if k % 2 else "assistant", f"turn {k % 5}") for k in range(300)]  # one key with a third of all rows
    out += [(c, k, "user", "the same") for c in range(410, 480) for k in range(3)]
    return out


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    for turns in own.values():
        turns.sort()
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = [(t[2], t[4]) for t in own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out, sums = {}, defaultdict(lambda: [0, 0, 0])
    for node, who in members.items():
        leaf = all(len(seqs[c]) == len(node) for c in who)
        if node:
            sums[node[:-1]][2] += 1
        for d in range(len(node) + 1):
            sums[node[:d]][0] += leaf
            sums[node[:d]][1] += (len(who) - 1) * len(node[-1][1]) if node else 0
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(seqs[c]) == len(node))
        out[min(who), len(node)] = (min(members[node[:-1]]) if node else None, len(who), sums[node][2], sums[node][0], sums[node][1], hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie(df, name, **how):
    out = prefix_trie.prefix_trie(df, Workspace(df.sparkSession, name), **how).collect()
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in out}
    assert len(found) == len(out)
    return found


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in conversation_rows()], "conv_id long, turn long, role string, text string, hash int, owner string").repartition(3)


def test_trie_against_plain(spark, conversations):
    assert trie(conversations, "trie1") == plain_trie(conversation_rows())


def test_conversations_that_span_many_partitions(spark, conversations):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert trie(conversations, "trie2") == plain_trie(conversation_rows())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_colliding_turns_and_fingerprints_are_split(spark, conversations):
    expected = plain_trie(conversation_rows())
    assert trie(conversations, "trie3", turn_hash=lambda role, text: F.pmod(F.xxhash64(role, text), F.lit(3))) == expected
    assert trie(conversations, "trie4", bits=3) == expected
    assert trie(conversations, "trie5", turn_hash=lambda role, text: F.lit(0), bits=0) == expected


def test_chunks_of_ends(spark, conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    ends = spark.createDataFrame([(1, 2, c) for c in range(-3, 40)] + [(2, 2, 7)], "owner long, depth long, conv_id long").repartition(6)
    found = {(r.owner, r.depth): r.ends_sha256 for r in prefix_trie.ends_digests(ends).collect()}
    assert found == {(1, 2): hashlib.sha256(",".join(map(str, range(-3, 40))).encode()).hexdigest(), (2, 2): hashlib.sha256(b"7").hexdigest()}


def test_trie_of_an_empty_table(spark, conversations):
    assert trie(conversations.limit(0), "trie6") == {}


def test_blocks_of_depth(spark, conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "DEPTH_BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "NODE_BLOCKS", 3)
    assert trie(conversations, "trie7") == plain_trie(conversation_rows())
