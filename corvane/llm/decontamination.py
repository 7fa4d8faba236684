"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Windows of the benchmark's items (``window`` consecutive words; the whole of a
shorter item) are the test strings.  Strings of equal length are searched
together: a block is the last two words of the current position (one word where
strings have one); the block shift table says how far the position may jump
without passing an occurrence; where the shift is zero, the bucket of the
position's suffix hash gives the test strings, and direct comparison of all
words confirms them.  All positions of a batch advance side by side in arrays.

Items are cut into pieces on the executors (``window`` - 1 words are in two
neighbours) and the pieces fall into blocks of about ``max_windows`` test strings.
One block at a time is on the driver and is broadcast.  If there is one block, hits
are found where the documents are read; of several, each leaves a table of its hits by document, which
are brought together by document at the end.

Defined cases: null and empty texts have no words and no hits; a very long text is searched whole, in
stretches; an item without words has no windows; an item without an id counts as one (all such together) but has no name in the
digest; items with equal windows are all counted; repeated rows and
ids are searched row by row; an empty benchmark leaves every document clean;
other columns are kept or ignored as asked, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane import ship
from corvane.llm.common import PLAIN_WORDS, Workspace, free_names, map_batches, sequential_segments, steps, text_bytes, word_stream

WINDOW = 10
#: Test strings of one searcher: with 10 words of 40 bytes each, below 64 MB.
MAX_WINDOWS = 100_000
#: Positions that one cursor scans.
STRETCH = 512
#: Column that find_overlap adds.
HITS = "_hits"


def plain_words(text: str | None) -> list[str]:
    """Words of a text: runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased."""
    return [] if text is None else [w.decode() for w in text.encode().translate(PLAIN_WORDS).split(b" ") if w]


class WuManber:
    """Test strings of equal length m (rows of word codes, all > 0) over streams of codes; code 0 is any other word, -1 ends a text."""

    def __init__(self, strings: np.ndarray):
        self.strings, self.m = strings, strings.shape[1]
        self.block = min(2, self.m)
        self.codes = int(strings.max()) + 2
        m, b = self.m, self.block
        # Shift by block, as sorted keys and values; a block that no string has allows m - b + 1.
        keys = np.concatenate([self._key(strings[:, i : i + b]) for i in range(m - b + 1)])
        shift = np.repeat(np.arange(m - b, -1, -1), len(strings))
        order = np.lexsort((shift, keys))
        first = np.ones(len(order), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        self.keys, self.shifts = keys[order][first], shift[order][first]
        # Buckets of strings by the hash of their last block.
        suffix = self._key(strings[:, m - b :])
        self.by_suffix = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.by_suffix]

    def _key(self, blocks: np.ndarray) -> np.ndarray:
        key = blocks[:, 0].astype(np.int64)
        return key * self.codes + blocks[:, 1] if self.block == 2 else key

    def find(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, string) of every occurrence in the stream."""
        m, b, n = self.m, self.block, len(stream)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, STRETCH)  # the last position of the window that is looked at
        stop = np.minimum(at + STRETCH, n)
        starts, strings = [], []
        while len(at):
            code = stream[at].astype(np.int64)
            known = code > 0
            if b == 2:
                before = stream[at - 1]
                known &= before > 0
                code = before * self.codes + code
            i = np.searchsorted(self.keys, code)
            i[i == len(self.keys)] = 0
            known &= self.keys[i] == code
            shift = np.where(known, self.shifts[i], m - b + 1)
            # No window holds a word that no string has: jump past it.
            shift = np.where((code if b == 1 else stream[at]) <= 0, m, shift)
            if len(ends := np.flatnonzero(shift == 0)):
                low = np.searchsorted(self.suffixes, code[ends], side="left")
                sizes = np.searchsorted(self.suffixes, code[ends], side="right") - low
                which = self.by_suffix[np.repeat(low, sizes) + sequential_segments(sizes)]
                start = np.repeat(at[ends] - m + 1, sizes)
                same = np.ones(len(start), bool)
                for k in range(m):
                    left = np.flatnonzero(same)
                    same[left] = stream[start[left] + k] == self.strings[which[left], k]
                starts.append(start[same])
                strings.append(which[same])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return (np.concatenate(starts), np.concatenate(strings)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Searcher:
    """All windows of some items."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        vocabulary = sorted({w for _, words in items for w in words})
        code = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.vocabulary = pa.array(vocabulary, pa.large_string())
        grouped: dict[int, dict[tuple[int, ...], set]] = {}
        for item, words in items:
            codes = [code[w] for w in words]
            size = min(window, len(codes))
            for i in range(len(codes) - size + 1 if size else 0):
                grouped.setdefault(size, {}).setdefault(tuple(codes[i : i + size]), set()).add(item)
        self.groups = [(WuManber(np.array(list(windows), np.int64)), list(windows.values())) for windows in grouped.values()]

    def search(self, flat: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
        """Hit words of the flat array, and the items of each text that has any."""
        n = len(offsets) - 1
        codes = pc.fill_null(pc.index_in(flat, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        text = np.repeat(np.arange(n), np.diff(offsets))
        # A text is followed by -1, which no string has.
        stream = np.full(len(codes) + n, -1, np.int64)
        place = np.arange(len(codes)) + text
        stream[place] = codes
        word = np.zeros(len(stream), np.int64)
        word[place] = np.arange(len(codes))
        change = np.zeros(len(codes) + 1, np.int64)
        items: dict[int, set] = {}
        for finder, owners in self.groups:
            starts, strings = finder.find(stream)
            first = word[starts]
            np.add.at(change, first, 1)
            np.add.at(change, first + finder.m, -1)
            for t, s in zip(text[first].tolist(), strings.tolist(), strict=True):
                items.setdefault(t, set()).update(owners[s])
        return np.cumsum(change[:-1]) > 0, items


#: Words of a piece of an item.
PIECE_WORDS = 2_000


def item_pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id (as a string), words and windows of pieces of all items that have a word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = plain_words(text)
                for i in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                    own = words[i : i + PIECE_WORDS + window - 1]
                    rows.append((item, own, max(1, len(own) - window + 1)))
            if rows:
                kinds = (pa.string(), pa.list_(pa.string()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item_id", "words", "windows"])

    ship(benchmark.sparkSession)
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    return own.mapInArrow(cut, "item_id string, words array<string>, windows long")


def searchers(benchmark: DataFrame, window: int, max_windows: int, work: Workspace) -> tuple[int, Iterator[Searcher]]:
    """The number of blocks, and their searchers one after another."""
    pieces = work.write(item_pieces(benchmark, window), "pieces")
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    n = max(1, -(-total // max_windows))
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(n))

    def each() -> Iterator[Searcher]:
        for k in range(n):
            # About max_windows test strings.
            yield Searcher([(r["item_id"], r["words"]) for r in pieces.where(block == k).collect()], window)

    return n, each()


_HIT = "struct<n_words: long, spans: array<struct<first: long, last: long>>, items: array<string>>"
_HIT_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _search(docs: DataFrame, searcher, name: str, hits_only: bool) -> DataFrame:
    """docs with the hits of one searcher (a broadcast), or only the rows that have any."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(_HIT))])

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, found = text_bytes(batch.column("text")), []
        for a, b in steps([len(x) for x in texts]):
            flat, offsets = word_stream([x.translate(PLAIN_WORDS) for x in texts[a:b]])
            hit, items = searcher.value.search(flat, offsets)
            for i in range(b - a):
                spans, names = [], items.get(i, ())
                if names:
                    own = hit[offsets[i] : offsets[i + 1]].astype(np.int8)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], own, [0]))))
                    spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                found.append({"n_words": int(offsets[i + 1] - offsets[i]), "spans": [{"first": x, "last": y} for x, y in spans], "items": sorted(names, key=lambda x: (x is not None, x))})
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _HIT_ARROW)], names=schema.names)
        return out.filter(pa.array([bool(x["items"]) for x in found])) if hits_only else out

    return map_batches(docs, search, schema)


def find_overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, name: str = HITS, work: Workspace | None = None) -> DataFrame:
    """docs with a struct of that name: n_words, spans (word intervals, joined), items (item_ids as sorted strings, null for those without one)."""
    context = docs.sparkSession.sparkContext
    work = work or Workspace(docs.sparkSession, "decontamination")
    n, each = searchers(benchmark, window, max_windows, work)
    if n == 1:
        return _search(docs, context.broadcast(next(each)), name, False)
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    tables = []
    for k, searcher in enumerate(each):
        sent = context.broadcast(searcher)
        found = _search(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), sent, HITS, True).select("id", key, f"{HITS}.spans", f"{HITS}.items")
        # Rows that repeat id and text have the same hits.
        tables.append(work.write(found.dropDuplicates(["id", "key"]), f"hits-{k}"))
        sent.destroy()
    hits = tables[0]
    for t in tables[1:]:
        hits = hits.unionByName(t)
    # A document's hits: at most one row a block.
    every = hits.groupBy("id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    own, doc_key, spans, items = free_names(docs, "_doc", "_key", "_spans", "_items")
    right = every.select(F.col("id").alias(own), F.col("key").alias(doc_key), F.col("spans").alias(spans), F.col("items").alias(items))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(doc_key))
    held = docs.join(right, same, "left").select(*[docs[c] for c in docs.columns], spans, items)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(_HIT))])

    def bring(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        texts = text_bytes(batch.column("text"))
        for text, parts, names in zip(texts, batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            joined = join_spans([(x["first"], x["last"]) for x in parts or ()])
            found.append({"n_words": len(text.translate(PLAIN_WORDS).split()), "spans": [{"first": x, "last": y} for x, y in joined], "items": sorted(names or (), key=lambda x: (x is not None, x))})
        return pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, _HIT_ARROW)], names=schema.names)

    return map_batches(held, bring, schema)


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of each document."""
    found = find_overlap(docs.select("doc_id", "text"), benchmark, window, max_windows)
    h = F.col(HITS)
    n_hit = F.aggregate(h["spans"], F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select(
        "doc_id",
        h["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
        (F.size(h["items"]) > 0).alias("contaminated"),
        h["spans"].alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    [name] = free_names(docs, HITS)
    return find_overlap(docs, benchmark, window, max_windows, name).where(F.size(F.col(name)["items"]) == 0).drop(name)


def digest(items: list[str]) -> str:
    """items_sha256 of these item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
