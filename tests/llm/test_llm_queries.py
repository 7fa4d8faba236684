"""The registered queries and the pipeline on small tables with odd rows, against SQL or plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_llm import BYTE, LICENSE_TEXTS, WORD, by_key, check_packing, plain_components, plain_counts, plain_fingerprint, plain_first, plain_removed, plain_words, rows

import corpus_pipeline
from corvane.llm import licenses, quality, queries
from corvane.llm.encoders import encoder, vocabulary

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _kept int, _doc string, size int"
TABLES = {
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string, words int",
    "pages": "page_id long, url string, html string, digest string",
    "conversations": "conv_id long, turn long, role string, text string, formatted int",
}


def document_rows():
    rng = random.Random(5)
    out = [(i, t, lang, "s", 1, 2, "x", 3) for i, t, lang, *_ in rows()]
    for k in range(30):
        lead = "And there was the rain of the hill and the stone near every wall.\n"
        line = " ".join(w.upper() + "!!" for w in rng.choices(["rain", "hill", "stone", "bird", "wall", "low"], k=14))
        out.append((500 + k, lead * (k % 2) + f"{line}\n{line[::-1]}\n" * 2 + f"{line} {k}!!", "en", "s", 0, 0, "", 0))
    prose = " ".join(f"w{i}" for i in range(60))
    out += [(600 + k, f"{prose} tail{k} of the text number{k}", "en", "s", 0, 0, "", 0) for k in range(5)]
    out += [(700 + k, t, "en", None, None, None, None, None) for k, t in enumerate(LICENSE_TEXTS)]
    return out


def table_rows():
    docs = document_rows()
    texts = [r[1] for r in docs if r[1] and len(r[1]) < 5000]
    rng = random.Random(6)
    page = ["<p>" + "é word " * 300 + "</p>", "x" * 999, "x" * 1000, "", None, "short"]
    return {
        "labels": [(r[0], int(r[0] < 500), 0) for r in docs if r[0] is not None and r[0] >= 0 and r[1]][:200] + [(None, 1, 0), (10**6, 0, None)],
        "benchmark": [(i, " ".join(rng.choice(texts).split()[2 : 2 + rng.randint(3, 25)]), 1) for i in range(12)] + [(90, None, 1), (91, "", 1), (92, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19", 2)],
        "pages": [(i, f"http://a.example/{i}", rng.choice(page), "d") for i in range(40)] + [(3, "http://again", page[0], None)],
        "conversations": [(c, t, rng.choice(["user", "assistant", None, "system"]), rng.choice(["</s>[INST] ok [/INST]", "a &lt; b", "", None, "plain words", "x\ny"]), 0) for c in range(20) for t in range(rng.randint(1, 5))],
    }


def write(spark, folder, empty=False):
    given = {"documents": document_rows(), **table_rows()}
    for name, schema in {"documents": DOCUMENTS, **TABLES}.items():
        spark.createDataFrame([] if empty else given[name], schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def single(spark, odd):
    """The odd tables without rows that share an id, which SQL joins by."""
    folder, ids = odd + "-single", Counter(r[0] for r in document_rows())
    spark.createDataFrame([r for r in document_rows() if r[0] is not None and ids[r[0]] == 1], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    for t in TABLES:
        spark.read.parquet(f"{odd}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), empty=True)


def run(spark, name, folder):
    return queries.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("kind", ["single", "empty"])
def test_query_equals_its_sql(spark, request, name, kind):
    folder = request.getfixturevalue(kind)
    con = duckdb.connect()
    for t in ("documents", *TABLES):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = queries.queries()[name](spark, folder)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert by_key([tuple(r[c] for c in names) for r in got.collect()]) == by_key(result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op1_chat_format"}))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert run(spark, name, empty) == []


def ids_of(name, text, end):
    return np.array([*encoder(vocabulary(name)).tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_query(spark, odd):
    got = sorted(run(spark, "op2_token_files", odd), key=lambda r: r["start"])
    want = Counter((r[0], len(x := ids_of(BYTE, r[1], 0)), zlib.crc32(x.tobytes())) for r in document_rows())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known) and [r["doc_id"] for r in got][: len(got) - len(known)] == [None] * (len(got) - len(known))


def test_line_dedup_query(spark, odd):
    given = [(r[0], r[1]) for r in document_rows()]
    gone = plain_removed(given)
    want = Counter()
    for i, t in given:
        own = sorted(gone.get((i, t), ()))
        want[i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in own), len(own), str(own)] += 1
    assert Counter((r["doc_id"], r["text"], r["n_removed"], str(r["removed_lines"])) for r in run(spark, "op4_line_dedup", odd)) == want


def pieces_of(given, end=1, capacity=4096):
    return Counter((i, k, at, len(own := x[at : at + capacity]), zlib.crc32(own.tobytes())) for i, t in given for x in [ids_of(WORD, t, end)] for k, at in enumerate(range(0, len(x), capacity)))


def test_packing_query(spark, odd):
    got = run(spark, "op5_best_fit_packing", odd)
    want = pieces_of([(r[0], r[1]) for r in document_rows()])
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    total = sum(k[3] * n for k, n in want.items())
    assert check_packing(got, 4096) <= math.ceil(total / 4096) + 1


def test_sharding_query(spark, odd):
    got = run(spark, "op6_sharding", odd)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in document_rows())
    homes, slots = defaultdict(set), defaultdict(list)
    for r in got:
        homes[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(x) == 1 for x in homes.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(40))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_license_query(spark, odd):
    want = Counter()
    for r in document_rows():
        words, places, found = plain_words(r[1]), [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places, found = places + here, found | ({label} if here else set())
        want[r[0], len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))] += 1
    got = run(spark, "op7_license_scan", odd)
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def plain_kept(text, field):
    n, _, _, _, repeated = plain_counts(text)
    if n < 10 or 100 * repeated > 20 * n:
        return False
    lines = [x for x in text.split("\n") if plain_counts(x)[0]]
    marks = field.viterbi(quality.line_features(lines))
    chars = [plain_counts(x)[1] for x in lines]
    return sum(c for c, m in zip(chars, marks, strict=True) if m) / sum(chars) >= field.share


def trained(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return quality.train_field(docs, labels)


def test_quality_query(spark, odd):
    field = trained(spark, odd)
    got = run(spark, "op8_quality_rules", odd)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]) for r in got) == Counter((r[0], *plain_counts(r[1]), plain_kept(r[1], field)) for r in document_rows())
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[500 + k] for k in range(30)) and sum(kept.values()) > 40


def test_simhash_query(spark, odd):
    prints = [(r[0], plain_fingerprint(r[1])) for r in document_rows()]
    groups = plain_components({f for _, f in prints})
    least = {f: min((i for i, g in prints if g in groups[f] and i is not None), default=None) for _, f in prints}
    assert Counter(tuple(r) for r in run(spark, "op9_simhash", odd)) == Counter((i, f"{f:016x}", least[f]) for i, f in prints)


def plain_hit(text, windows):
    words = plain_words(text)
    return any(tuple(words[k : k + size]) in own for size, own in windows.items() for k in range(len(words) - size + 1))


def test_pipeline_equals_plain_stages(spark, odd):
    """Each stage on all that the one before it kept, by plain versions."""
    field = trained(spark, odd)
    # One of the rows repeats an id with another text; here every id has one text.
    given, seen = [], {}
    for r in document_rows():
        if seen.setdefault(r[0], r[1]) == r[1]:
            given.append((r[0], r[1]))
    folder = odd + "-pipeline"
    wanted = spark.read.parquet(f"{odd}/documents.parquet").collect()
    first = {}
    spark.createDataFrame([r for r in wanted if first.setdefault(r["doc_id"], r["text"]) == r["text"]], DOCUMENTS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    for t in TABLES:
        spark.read.parquet(f"{odd}/{t}.parquet").write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    field = trained(spark, folder)
    kept = [(i, t) for i, t in given if plain_kept(t or "", field)]
    gone = plain_removed(kept)
    lined = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))) for i, t in kept]
    stay = set(plain_first(list(set(lined))))
    near = [(i, t) for i, t in dict(lined).items() if i in stay]
    windows = defaultdict(set)
    for _, t, *_ in table_rows()["benchmark"]:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[len(w[k : k + 10])].add(tuple(w[k : k + 10]))
    clean = [(i, t) for i, t in near if not plain_hit(t, windows)]
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces_of(clean)
    check_packing(got, 4096)
    assert len(kept) > len(stay) > len(clean) > 10 and any(gone.values())


def test_stages_keep_the_columns_and_take_empty_tables(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd).columns == docs.columns
