"""Corpus operators against plain versions, on small tables with odd rows."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import blocks, chat, common, decontamination, licenses, line_dedup, near_copies, packing, quality, sharding, simhash, token_files, warc
from corvane.llm.common import Workspace, hash_longs
from corvane.llm.encoders import encoder, vocabulary

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, fp long, _gone int, _id int, _hits string"


def prose(rng, n, words=("the", "of", "rain", "was", "there", "a", "hill", "über", "château", "and", "stone", "bird", "sings", "low", "near", "every", "wall")):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def rows(seed=7, n=60):
    """Documents with copies, near copies, odd rows and columns whose names clash with the operators' own."""
    rng = random.Random(seed)
    texts = ["\n".join(prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    texts += texts[:6] + [t.replace("rain", "snow", 1) for t in texts[:20]] + [t + "\nunder the MIT license" for t in texts[3:6]]
    texts += ["", None, "   \n\t ", "one", "two words", "x" * 30_000, ("again and again " * 4000).strip(), "é 漢字 🙂", "\x1c\x1d a\x1eb", None]
    out = [(i, t, "en", 5, 6, 7, "keep") for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (out[1][0], "another text of a repeated id", "en", 0, 0, 0, ""), (None, "no id here", None, None, None, None, None), (None, None, None, None, None, None, None), (-5, "negative id text", "en", 1, 1, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_key(found):
    return sorted(found, key=lambda r: tuple((x is not None, str(x)) for x in r))


# --- chat ---

ODD = ["</s>[INST] ok [/INST]", "<s>", "a &lt; b &amp;lt; &#91;", "[INST] x", "", None, " lead", "trail ", "[role=user] x", "</s", "&", "x\ny", "&#93;] ", "<", "[/INST]"]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "assistant", "system", "INST", "a] b", "</s>", None, "", "user "]), rng.choice(ODD), 9) for c in range(40) for t in range(rng.randint(1, 6))]
    turns += [(None, 0, "user", "hi", 1), (None, 1, "assistant", "yo", 1), (3, None, "user", "null turn", 1), (4, 0, "user", "same", 1), (4, 0, "user", "same", 1), (50, 0, "assistant", "x" * 200_000, 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    want = defaultdict(list)
    for c, t, r, x, _ in turns:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    formatted = chat.format_conversations(df)
    spans = {r["conv_id"]: r["spans"] for r in formatted.collect()}
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert set(got) == set(want)
    for c, w in want.items():
        w.sort()
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [x[2:] for x in w]
        assert got[c]["loss_texts"] == [x[3] for x in w if x[2] == "assistant"]
        body = got[c]["formatted"]
        assert body.count("<s>") == body.count("</s>") == len(w)
        for x, span in zip(w, spans[c], strict=True):
            text = body[span["start"] : span["end"]]
            for old, new in reversed(chat.CHARACTERS):
                text = text.replace(new, old)
            assert text == x[3] and span["loss"] == (x[2] == "assistant") and body[span["begin"] :].startswith("<s>")
        assert body.count("[INST]") == body.count("[/INST]") == sum(x[2] == "user" for x in w)
    assert {x for r in formatted.collect() for x in r["levels"]} == {0, 1, 2}


def test_chat_is_native_and_takes_empty_tables(spark):
    df = chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert df.collect() == []
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# --- tokens ---


def test_encoder_equals_library():
    rng = random.Random(1)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "İ", "Σ", "'s", "'LL", "é", "9", "²", "漢", "🙂", "\x1c", "!", "</s>", "<|endoftext|>", "ﬁ", " '", "'re", "_", "\r\n", " ", "×", "ǅ"]
    for name in (BYTE, WORD):
        enc = encoder(vocabulary(name))
        for _ in range(3000):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
            assert enc.encode(text) == enc._whole(text), repr(text)


def test_encoder_takes_added_tokens_as_the_library_does():
    from tokenizers import Tokenizer

    for name in (BYTE, WORD):
        path = vocabulary(name)
        plain, enc = Tokenizer.from_file(path), encoder(path)
        added = [x.content for x in plain.get_added_tokens_decoder().values()]
        for token in added:
            for text in (token, f"one {token} two", f"one{token}two", f"The end.{token}\n{token} Next", token.upper(), token[:-1]):
                want = plain.encode(text, add_special_tokens=False).ids
                assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == want, text
        assert added


def test_encoder_cache_is_bounded(monkeypatch):
    from corvane.llm import encoders

    monkeypatch.setattr(encoders, "CACHE_PIECES", 50)
    enc = encoders.Encoder(vocabulary(BYTE))
    enc._chunks.size = enc._heads.size = 50
    rng = random.Random(2)
    for _ in range(50):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(60))
        assert enc.encode(text) == enc._whole(text)
        assert len(enc._chunks) <= 50


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [3, 3, 9, 1000, 1000, 70_000], list(range(0, 90_000, 7)), [2**40, 2**40 + 1]])
def test_elias_fano(values):
    raw = token_files.EliasFano.encode(np.array(values, np.uint64))
    ef, rest = token_files.EliasFano.decode(memoryview(raw + b"tail"))
    assert bytes(rest) == b"tail" and ef.select_many(np.arange(len(values))).tolist() == values
    some = np.arange(0, len(values), 37)
    assert ef.select_many(some).tolist() == values[::37]
    for i in range(0, len(values), max(1, len(values) // 300)):
        assert ef.select(i) == values[i]
    with pytest.raises(IndexError):
        ef.select(len(values))
    if len(values) > 1000:
        assert len(raw) < 1.2 * len(values)  # near log2(u / n) + 2 bits, far below 8 bytes


def test_token_files(spark, docs, none):
    path, enc = vocabulary(BYTE), encoder(vocabulary(BYTE))
    work = Workspace(spark, "test")
    got = token_files.read_documents(work.write(token_files.token_segments(docs, path, 0, segment_ids=500), "a")).collect()
    tie = {r[0]: r[1] for r in docs.selectExpr("text", "xxhash64(text)").collect()}
    given = sorted([(r[0] is not None, r[0] or 0, tie[r[1]], r[1] is not None, r[1] or "") for r in rows()])
    want, start = [], 0
    for known, i, _, _, text in given:
        ids = np.array([*enc.tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert by_key(got) == by_key(want)
    assert token_files.read_documents(work.write(token_files.token_segments(none, path, 0), "b")).collect() == []
    few = work.write(token_files.token_segments(docs, path, 0, segment_documents=7), "c")
    assert by_key(token_files.read_documents(few).collect()) == by_key(want) and few.agg({"documents": "max"}).first()[0] == 7


def test_rows_without_an_id_are_dealt_out(spark):
    df = spark.createDataFrame([(None, f"text {k}") for k in range(400)], "doc_id long, text string").repartition(4)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        segments = Workspace(spark, "test-null").write(token_files.token_segments(df, vocabulary(BYTE), 0), "a")
    finally:
        spark.conf.unset(setting)
    assert segments.select("part").distinct().count() > 1 and token_files.read_documents(segments).count() == 400


# --- packing ---


def check_packing(pieces, capacity):
    bins = defaultdict(list)
    for p in pieces:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, docs, none):
    path, enc = vocabulary(WORD), encoder(vocabulary(WORD))
    pieces, placed = packing.pack_documents(docs, path, 1, capacity=256)
    got = placed.collect()
    want = []
    for r in rows():
        ids = np.array([*enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            own = ids[at : at + 256]
            want.append((r[0], k, at, len(own), zlib.crc32(own.tobytes())))
    assert by_key([(g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got]) == by_key(want)
    total = sum(x[3] for x in want)
    assert check_packing(got, 256) <= math.ceil(total / 256) + 2
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces, placed).collect()}
    own = {(r["doc_id"], r["piece"], r["ids_crc32"]): r["ids"] for r in pieces.collect()}
    for g in got:
        part = joined[g["sequence_id"]][2 * g["offset"] : 2 * (g["offset"] + g["length"])]
        assert bytes(part) == bytes(own[g["doc_id"], g["piece"], g["ids_crc32"]])
    assert sum(len(x) // 2 for x in joined.values()) == total and all(len(x) <= 512 for x in joined.values())
    assert packing.pack_documents(none, path, 1)[1].collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_pattern_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100, 4096])
    counts = dict(Counter(min(capacity, max(1, int(rng.lognormvariate(math.log(capacity / rng.choice([3, 8])), 1)))) for _ in range(rng.choice([1, 5, 40, 3000]))))
    used, total = Counter(), sum(k * v for k, v in counts.items())
    patterns = packing.plan_patterns(counts, capacity)
    for lengths, times in patterns:
        assert sum(lengths) <= capacity and times > 0
        used.update({x: times * lengths.count(x) for x in set(lengths)})
    assert dict(used) == counts
    bins = sum(t for _, t in patterns)
    assert bins >= math.ceil(total / capacity)
    if len(counts) > 30 and sum(counts.values()) >= 3000:
        assert bins <= math.ceil(total / capacity) * 1.01 + 1 or max(counts, key=counts.get) * 2 > capacity


def test_exact_complements_behind_spent_lengths_are_found():
    # Over 64 larger thirds whose pairs are spent, then one that has a pair left.
    have = packing._Counts(dict.fromkeys([*range(450, 501), *range(2000, 2101), 700, 800, 1096, 1500], 1), 4096)
    have.left[450:501] = 0
    assert sorted(have.exact(3000, (1096,))) == [700, 800, 1500]
    # Four pairs that the held lengths have used up, then one that is free.
    have = packing._Counts({x: 1 for x in (10, 20, 30, 40, 45, 55, 60, 70, 80, 90)}, 4096)
    assert have.pair(100, (10, 20, 30, 40)) == (45, 55)


def plain_filling(left, gap, held):
    """Whether one, two or three lengths fill the gap beside the held ones."""
    free = Counter({k: v for k, v in left.items() if v > 0})
    free.subtract(Counter(held))
    lengths = sorted(k for k, v in free.items() if v > 0 and k <= gap)
    for n in (1, 2, 3):
        for x in itertools.combinations_with_replacement(lengths, n):
            if sum(x) == gap and all(free[k] >= v for k, v in Counter(x).items()):
                return True
    return False


@pytest.mark.parametrize("seed", range(12))
def test_every_refusal_is_right(seed, monkeypatch):
    rng = random.Random(seed)
    capacity = rng.choice([30, 60, 90])
    counts = Counter(rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, capacity // 3) for _ in range(rng.choice([6, 15, 40])))
    monkeypatch.setattr(packing, "REINDEX", rng.choice([0, 2, 64]))
    asked, exact = [], packing._Counts.exact

    def watched(self, gap, held):
        found = exact(self, gap, held)
        asked.append(found is None)
        left = {k: int(v) for k, v in enumerate(self.left.tolist()) if v}
        assert (found is not None) == plain_filling(left, gap, held)
        return found

    monkeypatch.setattr(packing._Counts, "exact", watched)
    used = Counter()
    for lengths, times in packing.plan_patterns(dict(counts), capacity):
        used.update({x: times * lengths.count(x) for x in set(lengths)})
    assert used == counts and any(asked)


def test_exact_complements_are_consumed():
    assert packing.plan_patterns({6: 4, 4: 4}, 10) == [((6, 4), 4)]
    [(lengths, times)] = packing.plan_patterns({7: 1, 2: 1, 1: 1}, 10)
    assert sorted(lengths) == [1, 2, 7] and times == 1
    assert sum(t for _, t in packing.plan_patterns({7: 3, 1: 9}, 10)) == 3
    with pytest.raises(ValueError):
        packing.plan_patterns({11: 1}, 10)


# --- sharding ---


def best_capacity(sizes, shards):
    """Smallest largest sum of a contiguous partition, by dynamic programming."""
    prefix = [0, *itertools.accumulate(sizes)]
    best = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[j], prefix[i] - prefix[j]) for j in range(i)) for i in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(10))
def test_minimax(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 25))]
    k = rng.randint(1, 6)
    capacity, cuts = sharding.minimax_cuts(np.array(sizes), k)
    assert capacity == best_capacity(sizes, k) and len(cuts) <= k
    assert max(sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)) == capacity


def test_sharding(spark, docs, none):
    got = sharding.assign_shards(docs, shards=5).collect()
    given = [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows()]
    assert by_key([(g["doc_id"], g["size"], g["text_crc32"]) for g in got]) == by_key(given)
    slots, sums, homes = defaultdict(list), Counter(), defaultdict(set)
    for g in got:
        slots[g["shard"]].append(g["slot"])
        sums[g["shard"]] += g["size"]
        homes[g["text_crc32"]].add(g["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(5))
    assert all(len(x) == 1 for x in homes.values())
    assert sharding.assign_shards(none).collect() == []


def test_written_shards_hold_every_row_once(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs.withColumnRenamed("lang", "slot"), path, shards=5)
    out = spark.read.parquet(path)
    assert by_key(out.select("doc_id", "text", "fp").collect()) == by_key((r[0], r[1], r[3]) for r in rows())
    homes = defaultdict(set)
    for r in out.select("text", "shard", "slot").collect():
        homes[r["text"] or ""].add(r["shard"])
    assert all(len(x) == 1 for x in homes.values())
    want = by_key((r["shard"], r["slot"]) for r in sharding.assign_shards(docs, shards=5).collect())
    assert by_key(tuple(r) for r in out.select("shard", "slot").collect()) == want


def test_rows_without_an_id_have_many_salts(spark):
    df = spark.createDataFrame([(None, "one text")] * 500, "doc_id long, text string").repartition(2)
    assert sorted(r["slot"] for r in sharding.assign_shards(df, shards=3).collect()) == list(range(500))


def test_large_groups_have_their_own_shard():
    single, ends = sharding.plan_shards(np.arange(100), np.array([10] * 50 + [5000] + [10] * 49), 5)
    assert single == {50: 0}
    sizes = np.diff([0, *ends, 100])
    assert len(ends) == 3 and max(sizes) - min(sizes) <= 2


# --- licenses ---


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


LICENSE_TEXTS = [
    "Released under the MIT License. Released under-the  mit\nlicense!", "Apache License, Version 2.0", "apachelicense version 2", "cc by-nc and CC BY NC", "under the mit licenses", None, "",
    "Licensed under the MlT license today", "licensed under teh apache lisence version 2 0", "Permission is hereby grantd, free of charge, to any persn obtaining a copy of it",
    "nothing of the kind " * 2000 + "all right reserved" + " tail" * 2000, "GNU Lesser General Public Licence", "all reserved rights",
]


def test_licenses(spark, none):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LICENSE_TEXTS)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    for i, text in enumerate(LICENSE_TEXTS):
        words, places, found = plain_words(text), [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += here
            found |= {label} if here else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)))
        # Without seeds: the bounded-error pattern over the whole string of words.
        whole = " ".join(words)
        loose = {n.label for n in map(lambda x: licenses.Notice(*x), licenses.NOTICES) if any(not any(m.fuzzy_counts) or n.means_it(m.group().split()) for m in n.pattern.finditer(whole))}
        assert r["labels"] == ",".join(sorted(found | loose)) and 0 <= r["score"] <= 1
        assert (r["score"] == 0) == (r["labels"] == "")
    assert "mit" in got[7]["labels"] and "mit" in got[9]["labels"] and got[12]["labels"] == "" and "all-rights-reserved" in got[10]["labels"]
    assert licenses.license_scan(none).collect() == []


MISSPELT = {
    "mit": ["Released under the MIT licence", "released undr the MIT license", "Released under the MlT Licence", "under teh MIT license"],
    "apache-2": ["Apache Licence, Version 2.0", "the apach license version 2", "Apache Lisense Version 2", "apache license verson 2 0"],
    "cc-by-nc": ["licensed under cc by-nx", "CC BYNC", "cc b-nc", "licenced under cc by-nx", "published as cc by mc"],
}


def test_misspelt_base_phrases(spark):
    texts = [(label, x) for label, each in MISSPELT.items() for x in each] + [("", x) for x in ("CC BY-ND", "licensed under CC BY-SA", "licensed under cc by nd", "released under the MPL license", "Apache License, Version 1.1", "apache lisence version 1", "apache license")]
    # Every single edit of each phrase's letters.
    texts += [(label, "so " + phrase[:i] + edit + phrase[i + 1 :] + " it") for phrase, label in licenses.BASE_PHRASES.items() for i in range(1, len(phrase) - 1) if phrase[i] not in " 2" for edit in ("", "q", phrase[i] + "q")]
    got = licenses.license_scan(spark.createDataFrame([(i, f"before {x} after") for i, (_, x) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {texts[r["doc_id"]]: r["labels"] for r in got} == {x: x[0] for x in texts}
    assert all((r["score"] > 0) == (r["labels"] != "") for r in got)


# --- quality ---


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def test_quality_counts(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_verdicts(docs, labels).collect()
    want = []
    for r in rows():
        n, chars, symbols, dup, rep = plain_counts(r[1])
        failed = n < 10 or 100 * rep > 20 * n
        want.append((r[0], n, chars, symbols, dup, rep, failed, not failed))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert by_key([tuple(g[c] for c in names) for g in got]) == by_key(want)
    assert quality.quality_verdicts(none, labels).collect() == []
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(20):
        field = quality.LineField(rng.normal(size=(2, quality.FEATURES)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(rng.integers(1, 8), quality.FEATURES))
        s = x @ field.emit.T
        best = max(itertools.product((0, 1), repeat=len(x)), key=lambda p: sum(s[i, a] for i, a in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert field.viterbi(x).tolist() == list(best)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the generated tables")
def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    trained = {r[0] for q in (0, 1) for r in labels.where(f"quality = {q}").selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").limit(20).collect()}
    got = quality.quality_verdicts(docs, labels, train_docs=40).join(labels, "doc_id").collect()
    right = [g["kept"] == (g["quality"] == 1) for g in got if g["doc_id"] not in trained and not g["base_failed"]]
    assert len(right) > 200 and sum(right) / len(right) > 0.95


def test_training_takes_its_documents_within_the_bound_and_whole_texts(spark, monkeypatch):
    # The first ids by hash are too long; the sample is filled from the others.
    texts = {i: ("long line of words here\n" * 50 if i % 2 else "\n".join(f"line {k} of {i}" for k in range(30))) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 2 % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    taken = []
    monkeypatch.setattr(quality, "fit_field", lambda sequences, chars, gold: taken.append((sequences, gold)))
    quality.train_field(df, labels, train_docs=20, train_chars=600, train_lines=10)
    sequences, gold = taken[0]
    assert len(gold) == 20 and sum(gold) == 10 and {len(x) for x in sequences} == {10}
    assert quality.spread_lines(np.arange(30), 4).tolist() == [0, 10, 19, 29] and quality.spread_lines(np.arange(3), 4).tolist() == [0, 1, 2]


def labelled(d="/root/testdata/sf0.01"):
    docs, labels = pq.read_table(f"{d}/documents.parquet").to_pydict(), pq.read_table(f"{d}/labels.parquet").to_pydict()
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    out = sorted((i, texts[i], q) for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if texts.get(i) and len(texts[i]) <= 20_000)
    random.Random(3).shuffle(out)
    return [[x[1] for x in out if x[2] == kind] for kind in (0, 1)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the generated tables")
def test_lines_are_labelled_one_by_one():
    bad, good = labelled()
    half = len(bad) // 2
    texts, gold = bad[:half] + good[:half], [0] * half + [1] * half
    lines = [quality.text_stats(x)[1] for x in texts]
    field = quality.fit_field([quality.line_features(x) for x in lines], [quality.word_chars(x) for x in lines], gold)
    # Lines of bad documents that anyone can tell, spliced into good ones that the field hasn't seen.
    rng = random.Random(5)
    told = re.compile(r"!!.*!!|([$*%&#]{3}.*){3}|(\|.*){4}")
    runs = [x for text in bad[half:] if (x := [y for y in quality.text_stats(text)[1] if told.search(y)][:3])]
    hits = wrong = lost = 0
    for text in good[half:]:
        own, run = quality.text_stats(text)[1], rng.choice(runs)
        at = rng.randrange(len(own) + 1)
        marks = field.viterbi(quality.line_features([*own[:at], *run, *own[at:]]))
        inside = marks[at : at + len(run)]
        hits, lost, wrong = hits + int((inside == 0).sum()), lost + int(inside.sum()), wrong + int((marks == 0).sum() - (inside == 0).sum())
    assert hits / (hits + lost) >= 0.9 and hits / (hits + wrong) >= 0.9
    decoded = [quality.judge_text(x, field)[3] for x in bad[half:] + good[half:]]
    assert sum("0" in x and "1" in x for x in decoded) > 5


def test_field_tells_runs_in_made_sequences():
    rng = np.random.default_rng(8)

    def lines(kind, n):
        x = rng.normal(0, 0.2, (n, quality.FEATURES))
        x[:, 0], x[:, 1] = 1, kind + rng.normal(0, 0.2, n)
        return x

    sequences, gold = [], []
    for label in (0, 1) * 60:
        parts = [lines(label, 6), lines(1 - label, 2)] if rng.random() < 0.5 else [lines(label, 6)]
        sequences.append(np.concatenate(parts))
        gold.append(label)
    field = quality.fit_field(sequences, [np.ones(len(s), np.int64) for s in sequences], gold)
    got = field.viterbi(np.concatenate((lines(1, 8), lines(0, 4), lines(1, 8))))
    assert got.tolist() == [1] * 8 + [0] * 4 + [1] * 8 and 0.25 < field.share < 0.75


# --- simhash ---


def plain_fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(points, radius=4):
    """fingerprint -> set of fingerprints reachable."""
    left, out = set(points), {}
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        out |= dict.fromkeys(group, group)
    return out


def test_covering_masks():
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 31
    rng = random.Random(5)
    for _ in range(5000):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not bits & m for m in masks)
    families = [simhash.mask_family(turn, 4) for turn in range(len(simhash.ORDERS))]
    for _ in range(2000):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert all(any(not bits & m for m in family) for family in families)
    # All three together leave few bits free.
    free = [64 - (a | b | c).bit_count() for a in families[0] for b in families[1] for c in families[2]]
    assert sum(free) / len(free) < 9


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    groups = plain_components({f for _, f in prints})
    least = {f: min((i for i, g in prints if g in groups[f] and i is not None), default=None) for _, f in prints}
    assert by_key([tuple(g) for g in got]) == by_key([(i, f"{f:016x}", least[f]) for i, f in prints])
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.keep_first(docs).collect()
    assert len(kept) == len({id(groups[f]) for _, f in prints}) and simhash.keep_first(docs).columns == docs.columns


@pytest.mark.parametrize("split", [4, 128])
def test_links_of_dense_fingerprints(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(split)
    points = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            points.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    work = Workspace(spark, "test-links")
    table = work.write(spark.createDataFrame([(p,) for p in signed], "fp long"), "points")
    got = {r["fp"] & (1 << 64) - 1: r["comp"] & (1 << 64) - 1 for r in simhash.link_fingerprints(table, work).collect()}
    groups = plain_components(points)
    found = defaultdict(set)
    for p in points:
        found[got.get(p, p)].add(p)
    assert {frozenset(x) for x in found.values()} == {frozenset(x) for x in groups.values()}


class PlanKeeper(Workspace):
    """Keeps the plans of the tables that it writes."""

    def write(self, df, table, codec="zstd"):
        self.plans = getattr(self, "plans", {}) | {table: df._jdf.queryExecution().executedPlan().toString()}
        return super().write(df, table, codec)


def test_exploded_rows_are_not_broadcast(spark):
    work = PlanKeeper(spark, "test-plans")
    points = work.write(spark.createDataFrame([(1,), (2,), (1 << 40,)], "fp long"), "points")
    simhash.link_fingerprints(points, work)
    near_copies.link_texts(work.write(spark.createDataFrame([(1, [5, 6]), (2, [5])], "id long, bands array<long>"), "classes"), spark.createDataFrame([(1, "a b"), (2, "a b")], "id long, text string"), near := PlanKeeper(spark, "test-plans"))
    for plan in (work.plans["buckets"], work.plans["rows-1"], work.plans["rows-2"], near.plans["buckets"]):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


# --- near copies of the pipeline ---


def five_word_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_first(given, similarity=0.8):
    """doc_ids that stay: the smallest of each component of distinct (doc_id, text) rows."""
    sets = [five_word_shingles(t) for _, t in given]
    root = list(range(len(given)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(given)), 2):
        x, y = sets[i], sets[j]
        if x == y or len(x & y) >= similarity * len(x | y) - 1e-9:
            root[find(j)] = find(i)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(given):
        groups[find(i)].append(doc_id)
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)


def planted_copies():
    """Texts of invented words with copies at similarities about 0.7 to 0.95; (doc_id, text) rows."""
    rng, out = random.Random(11), []
    for base in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((60, 200, 600)))]
        out.append((base, " ".join(words)))
        for k, share in enumerate((0.005, 0.01, 0.018, 0.022, 0.035)):
            changed = list(words)
            for i in rng.sample(range(len(words)), max(1, round(share * len(words)))):
                changed[i] = f"x{rng.randrange(10**6)}"
            out.append((1000 + 10 * base + k, "  ".join(changed).upper()))
    return out


def test_pipeline_takes_near_copies_from_similarity_on(spark, none):
    import corpus_pipeline

    given = planted_copies()
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(given, "doc_id long, text string").repartition(3), "")
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == plain_first(given)
    close = sum(0.8 <= len(x & y) / len(x | y) < 0.95 for base in range(40) for x in [five_word_shingles(given[6 * base][1])] for y in [five_word_shingles(given[6 * base + k][1].lower()) for k in range(1, 6)])
    assert close > 50
    assert near_copies.keep_first(none).collect() == []


def test_pipeline_takes_candidates_by_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    # Without bands, only linked fingerprints bring these together; the shingles decide.
    monkeypatch.setattr(near_copies, "band_keys", lambda texts, shingle=5: [near_copies.np.array([hash(x)]) if x.split() else near_copies.np.zeros(0, "i8") for x in texts])
    words = [f"w{i}" for i in range(400)]
    given = [(3, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (7, " ".join([*words, *words[:9]])), (5, "to to to to"), (4, "to to to to to"), (1, None), (6, "")]
    df = spark.createDataFrame(given, "doc_id long, text string")
    prints = [simhash.fingerprint((t or "").encode()) for _, t in given]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 and prints[3] == prints[4]
    assert near_copies.keep_first(df).count() == 6
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()) == plain_first(given)


def test_near_copies_of_odd_rows(spark, docs):
    given = list({(r["doc_id"], r["text"]) for r in docs.collect()})
    got = near_copies.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == plain_first(given)


def test_chained_near_copies_are_one_component(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[: 100 + 4 * k]) for k in range(40)] + [" ".join(words[200 - 3 * k :]) for k in range(20)]
    given = list(enumerate(texts))
    got = near_copies.keep_first(spark.createDataFrame(given, "doc_id long, text string"))
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == plain_first(given)


# --- decontamination ---


def test_decontamination(spark, docs, none, monkeypatch):
    rng = random.Random(11)
    texts = [r[1] for r in rows() if r[1] and len(r[1]) < 5000]
    items = [" ".join(t.split()[k : k + rng.randint(3, 30)]) for t in rng.sample(texts, 15) for k in (0, 5)]
    items += ["", None, "...", "one", "again", "words that occur nowhere at all here", items[0], items[0].upper()]
    ids = [None if i in (3, 8) else i for i in range(len(items))]
    bench = spark.createDataFrame([(ids[i], t, 1) for i, t in enumerate(items)], "item_id long, text string, n_words int")
    windows = defaultdict(set)
    for i, t in enumerate(items):
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(ids[i])
    want = []
    for r in rows():
        w, hit, found = plain_words(r[1]), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    found |= own
                    hit |= set(range(k, k + size))
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit)))
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 4)
    for limit in (100_000, 40):
        got = decontamination.contamination(docs, bench, max_windows=limit).drop("spans").collect()
        assert by_key([tuple(g) for g in got]) == by_key(want)
    assert decontamination.contamination(none, bench).collect() == []
    clean = decontamination.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(rows()) and not any(c["contaminated"] for c in clean)
    for limit in (100_000, 40):
        assert decontamination.drop_contaminated(docs, bench, max_windows=limit).count() == sum(not w[-1] for w in want)
    blocks, each = decontamination.searchers(bench, 10, 30, Workspace(spark, "test-blocks"))
    assert blocks >= 10 and sum(1 for _ in each) == blocks


def test_wu_manber_skips_and_finds():
    rng = np.random.default_rng(4)
    for m in (1, 2, 3, 10):
        strings = np.unique(rng.integers(1, 6, (12, m)), axis=0)
        stream = rng.integers(-1, 7, 5000)
        starts, which = decontamination.WuManber(strings).find(stream)
        got = sorted(zip(starts.tolist(), which.tolist(), strict=True))
        assert got == [(i, k) for i in range(len(stream) - m + 1) for k, s in enumerate(strings) if (stream[i : i + m] == s).all()]


# --- warc ---


def test_warc(spark):
    rng = random.Random(9)
    big = ["<p>" + prose(rng, 400) + "</p>" for _ in range(5)] + ["é" * 600, "y" * 999, "z" * 1000]
    pages = [(i, f"http://a.example/{i} ü", rng.choice([*big, "", None, "short"]), "x") for i in range(60)]
    pages += [pages[3], pages[3], (None, None, big[0], None), (None, "u", "short", None), (900, "u", "x" * 300_000, ""), (901, "u", "x" * 300_000, "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    table = Workspace(spark, "test-warc").write(warc.archives(df, segment_bytes=700, member_bytes=4000), "a")
    got = warc.read_pages(table).collect()
    top = {}
    for i, _, h, _ in pages:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(i, top.get(h, i))
    want = []
    for i, _, h, _ in pages:
        raw = (h or "").encode()
        to = top[h] if h in top and i is not None and i < top[h] else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    assert by_key([tuple(g) for g in got]) == by_key(want)
    assert warc.parsed_records(table).where("segment > 1").count() > 50
    assert warc.read_pages(Workspace(spark, "test-warc").write(warc.archives(df.limit(0)), "a")).collect() == []


def test_warc_export_and_faults(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 5000), (2, "v", "short")], "page_id long, url string, html string")
    work = Workspace(spark, "test-warc")
    table = work.write(warc.archives(df, segment_bytes=1000), "a")
    assert warc.export_archives(table, str(tmp_path)) >= 1
    found = [r for p in sorted(tmp_path.iterdir()) for r in warc.records(p.read_bytes())]
    assert sum(h["warc-type"] == "continuation" for h, _ in found) >= 5
    assert warc.dechunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000 and warc.dechunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n")
    kept = [warc.record([(k, v) for k, v in h.items() if k != "content-length"], b) for h, b in found if h.get("warc-segment-number") != "2"]
    broken = spark.createDataFrame([(0, 0, b"".join(kept))], "archive int, member int, warc binary")
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_pages(broken).collect()


def test_revisits_refer_to_records_that_are_there(spark):
    df = spark.createDataFrame([(k, "u", "x" * 5000) for k in range(4)] + [(9, "v", "y" * 3000)], "page_id long, url string, html string")
    raw = b"".join(r["warc"] for r in warc.archives(df.coalesce(1)).collect())
    found = list(warc.records(raw))
    ids = {h["warc-record-id"] for h, _ in found}
    assert all(h["warc-refers-to"] in ids for h, _ in found if h["warc-type"] == "revisit") and sum(h["warc-type"] == "revisit" for h, _ in found) == 3

    def read(kept):
        whole = b"".join(warc.record([(k, v) for k, v in h.items() if k != "content-length"], b) for h, b in kept)
        return warc.read_pages(spark.createDataFrame([(0, 0, whole)], "archive int, member int, warc binary")).collect()

    assert len(read(found)) == 5
    lost = [(h, b) for h, b in found if not (h["warc-type"] == "response" and h["x-page-id"] == "3")]
    with pytest.raises(ValueError, match="missing or differs"):
        read(lost)
    # The referred record has another payload, sound in itself.
    other = warc.chunked(b"z" * 5000)
    digest = hashlib.sha1(b"z" * 5000).hexdigest()
    changed = [(h | {"warc-payload-digest": f"sha1:{digest}"}, b[: b.index(b"\r\n\r\n") + 4] + other) if h["warc-type"] == "response" and h["x-page-id"] == "3" else (h, b) for h, b in found]
    with pytest.raises(ValueError, match="missing or differs"):
        read(changed)


# --- line dedup ---


def plain_removed(given, similarity=0.8):
    """(doc_id, text) -> line numbers that go."""
    lines = []
    for doc_id, text in set(given):
        key = xxhash.xxh64_intdigest((text or "").encode(), 42)
        key = key - (1 << 64) if key >> 63 else key
        for k, line in enumerate((text or "").encode().split(b"\n")):
            if words := frozenset(line.lower().split()):
                lines.append(((doc_id is None, doc_id or 0, k), key, words, (doc_id, text, k)))
    # A class is where its first line is; classes at the same place are told apart by their sets' own hashes.
    classes = {}
    for place, key, words, _ in lines:
        classes[words] = min(classes.get(words, (place, key)), (place, key))
    ids = {w: int(line_dedup.LineSets([b" ".join(w)], None).id[0]) for w in classes}
    gone = defaultdict(set)
    for place, key, words, at in lines:
        first = classes[words]
        near = (w for w in classes if w != words and len(words & w) >= similarity * len(words | w) - 1e-9)
        if (place, key) != first or any((classes[w][0], ids[w]) < (first[0], ids[words]) for w in near):
            gone[at[:2]].add(at[2])
    return gone


#: The second bounds are so small that neighbourhoods, groups and later rounds are in use.
LIMITS = (line_dedup.Limits(), line_dedup.Limits(keep=1, full=3, window=1, group=2, fold=64, pairs=128))


@pytest.mark.parametrize("limits", LIMITS)
def test_line_dedup(spark, docs, none, limits):
    given = [(r[0], r[1]) for r in rows()]
    gone = plain_removed(given)
    got = line_dedup.dedup_lines(docs, counts=True, limits=limits).collect()
    want = []
    for i, t in given:
        own = sorted(gone.get((i, t), ()))
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in own)
        n = sum(1 for x in (t or "").encode().split(b"\n") if x.split())
        want.append((i, kept, n, len(own), str(own)))
    assert by_key([(g["doc_id"], g["text"], g["n_lines"], g["n_removed"], str(g["removed_lines"])) for g in got]) == by_key(want)
    assert line_dedup.dedup_lines(none).collect() == [] and line_dedup.dedup_lines(docs).columns == docs.columns


@pytest.mark.parametrize("limits", LIMITS)
def test_line_dedup_of_many_near_copies(spark, limits):
    rng = random.Random(21)
    base = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(30)] = f"v{rng.randrange(60)}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.sample(["a", "b", "c", "d", "e", "f", "g"], rng.randint(1, 7))) for _ in range(150)]
    given = list(enumerate(texts))
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    gone = plain_removed(given)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df, counts=True, limits=limits).collect()}
    assert got == {i: len(gone.get((i, t), ())) for i, t in given}


@pytest.mark.parametrize("limits", LIMITS)
def test_line_dedup_of_large_sets(spark, limits):
    rng = random.Random(22)
    base, texts = [f"w{i}" for i in range(400)], []
    for n in (90, 100, 120, 300, 380):
        for _ in range(8):
            words = base[:n]
            for k in rng.sample(range(n), rng.randint(0, n // 6)):
                words[k] = f"v{rng.randrange(900)}"
            texts.append(" ".join(words))
    given = list(enumerate(texts))
    gone = plain_removed(given)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(given, "doc_id long, text string"), counts=True, limits=limits).collect()}
    assert got == {i: len(gone.get((i, t), ())) for i, t in given} and 5 < sum(got.values()) < 40


@pytest.mark.parametrize("limits", (*LIMITS, line_dedup.Limits(keep=1, full=40, window=4, group=30, share=64)))
def test_line_dedup_of_few_words_in_all_lines(spark, limits):
    """All sets of ten words, each with the word that is in every line: one prefix word has half of the rows."""
    words = [f"w{k}" for k in range(10)]
    texts = ["every " + " ".join(w for k, w in enumerate(words) if n >> k & 1) for n in range(1 << 10)]
    random.Random(23).shuffle(texts)
    given = list(enumerate(texts))
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    gone = plain_removed(given)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df, counts=True, limits=limits).collect()}
    assert got == {i: len(gone.get((i, t), ())) for i, t in given} and sum(got.values()) > 100


def test_line_dedup_deals_out_rows_of_one_word(spark):
    """Lines of a word that all share: its rows are in parts of about ``full`` rows, so no cell has them all."""
    limits = line_dedup.Limits(full=100)
    lines = [f"hot cold{k} cold{k}b" for k in range(40)] + ["hot " + " ".join(f"v{k % m}" for m in (7, 11, 13, 17)) for k in range(4000)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    one = "hot " + " ".join(f"u{k}" for k in range(3))
    df = df.union(spark.createDataFrame([(5000 + k, one) for k in range(300)], "doc_id long, text string"))
    work = common.Workspace(spark, "dealt")
    # Without counts of words their order is that of hashes, so frequent words are in prefixes.
    flat = spark.sparkContext.broadcast(np.ones(1 << line_dedup.COUNTER_BITS, np.uint8))
    classes = line_dedup.line_classes(df, flat, 0.2, work, limits)
    counted = line_dedup.word_rows(classes, limits)
    assert counted.max() > 1000
    parts = spark.sparkContext.broadcast(np.maximum(1, -(-counted // limits.full)).astype(np.uint32))

    def largest(parts):
        rows = {}
        for r in line_dedup.deal_by_word(classes, parts, limits=limits).collect():
            word = blocks.unpack(r["block"])[0]
            for w, n in zip(*np.unique(word, return_counts=True), strict=True):
                rows[int(w)] = rows.get(int(w), 0) + int(n)
        return max(rows.values()), sum(rows.values())

    whole = spark.sparkContext.broadcast(np.ones(1 << line_dedup.HEAVY_BITS, np.uint32))
    (split, n), (together, m) = largest(parts), largest(whole)
    assert n == m and split <= 2 * limits.full and together > 1000


def test_line_dedup_steps_read_only_the_columns_of_classes_that_they_use(spark):
    df = spark.createDataFrame([(k, f"a line of word{k % 40} and of other{k % 7}\nanother of word{k}") for k in range(200)], "doc_id long, text string")
    flat = spark.sparkContext.broadcast(np.ones(1 << line_dedup.COUNTER_BITS, np.uint8))
    classes = line_dedup.line_classes(df, flat, 0.8, common.Workspace(spark, "columns"))
    gone = spark.createDataFrame([], "b_doc long, b_line int, b_id long")
    kept = line_dedup._kept_by_document(classes, gone)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "head:binary" in plan and "small:binary" not in plan and "prefix:binary" not in plan
    assert sum(len(r["kept"]) for r in kept.collect()) == 200 + 200  # no two lines are of the same words


def test_first_places_of_classes_that_share_half_of_their_hash():
    made = np.random.default_rng(5)
    columns = [made.integers(0, high, 4000).astype(kind) for high, kind in ((900, np.uint64), (2, np.uint64), (2, np.uint8), (30, np.int64), (4, np.int64), (5, np.uint64))]
    ones = np.ones(4000, np.uint64)
    own = line_dedup.Classes([*columns, ones, ones, ones.astype(np.uint16), ones])
    want = {}
    for i, i2, known, doc, key, line in zip(*(x.tolist() for x in columns), strict=True):
        want[i, i2] = min(want.get((i, i2), (9,)), (1 - known, doc, line, key))
    at = own.first_places()
    assert len(at) == len(want)
    assert {(int(own.id[k]), int(own.id2[k])): (1 - int(own.known[k]), int(own.doc[k]), int(own.line[k]), int(own.key[k])) for k in at} == want


def test_line_dedup_of_a_document_of_many_lines(spark):
    lines = [f"word{k} and more of line {k} than of others {k + 1}" for k in range(1_000_000)]
    lines[5000] = lines[70].upper()
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    began = time.time()
    [row] = line_dedup.dedup_lines(df, counts=True).select("n_lines", "n_removed", "removed_lines").collect()
    assert row["n_lines"] == 1_000_000 and 5000 in row["removed_lines"] and time.time() - began < 120
    assert not {*range(70)} & set(row["removed_lines"])


def test_a_cluster_has_to_name_a_shared_folder(spark):
    from types import SimpleNamespace

    def session(master, folder):
        given = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "file:/w/"}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: given.get(k) or default), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert common.shared_dir(session("yarn", "s3://x/")) == "s3://x"
    assert common.shared_dir(session("local[2]", None)) == "file:/w/_work"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077", None))


def test_work_tables_leave_the_settings_as_they_were(spark):
    before = {k: spark.conf.get(k) for k in (common.CLEANUP, *common.BATCH_LIMITS)}
    work = Workspace(spark, "test-settings")
    assert work.write(spark.range(5), "a").count() == 5
    with pytest.raises(Exception, match="no"):
        work.write(spark.range(5).select(F.raise_error(F.lit("no"))), "b")
    assert {k: spark.conf.get(k) for k in before} == before


def test_blocks_hold_what_they_were_given():
    columns = [np.array([1, 300, 2**40], np.uint64), np.array([-1, 5]), np.zeros(0, np.uint16), np.array([True, False]).astype(np.uint8)]
    for given, got in zip(columns, blocks.unpack(blocks.pack(columns)), strict=True):
        assert given.tolist() == got.tolist()


def test_long_hash_equals_spark(spark):
    values = [0, 1, -1, 42, 2**62, -(2**63), 123456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").selectExpr("xxhash64(v)").collect()]
    assert hash_longs(np.array(values, np.int64)).view(np.int64).tolist() == got


OTHER_NOTICES = {
    "apache license version 3": "", "mozilla public license version 1 1": "", "eclipse public license version 1": "", "spdx license identifier mpl 2 0": "", "spdx license identifier apache 1 1": "", "licensed under the bsl license": "",
    "cc by na": "", "cc by nd": "", "licensed under cc by sa": "", "under the exit license": "", "under the edit license": "", "under the nist license": "", "under the mpl license": "", "under the ms license": "", "boost software license version 2 0": "",
    "spdx license identifier bsd 2 clause": "", "gnu general public licence": "gpl", "Apache Licence, Version 2.0": "apache-2", "released under the MIT licence": "mit", "cc by-nx": "cc-by-nc", "licensd under the apche license version 2.0": "apache-2", "under themit license": "mit",
}


def test_notices_of_other_licenses_are_no_misspellings():
    for text, label in OTHER_NOTICES.items():
        assert ",".join(sorted({x[2] for x in licenses.scan_text(f"some words {text} and more".encode())["spans"]})) == label, text


def test_notices_against_each_other():
    """A notice has the labels of the notices that it holds as they are, and keeps its own with an edit at any place of its frame."""
    rng = random.Random(12)
    for wording, label, _ in licenses.NOTICES:
        held = {x for w, x, _ in licenses.NOTICES if f" {w} " in f" {wording} "}
        assert {x[2] for x in licenses.scan_text(f"before {wording} after".encode())["spans"]} == held, wording
        frame = [i for i, c in enumerate(wording) if c.isalpha() and 0 < i < len(wording) - 1]
        for i in rng.sample(frame, min(12, len(frame))):
            for edit in ("", "q", wording[i] + "q"):
                found = {x[2] for x in licenses.scan_text(f"before {wording[:i]}{edit}{wording[i + 1 :]} after".encode())["spans"]}
                assert label in found, (wording, i, edit)
