"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased, split at ASCII white space).
Lines of equal sets are one class; a class matches another if the Jaccard
similarity of their sets is at least ``SIMILARITY``.  A line is removed if an
earlier line (by doc_id, then line number, then class) has the same set or a matching one, so
of each matching pair the later line goes.  Lines without a word always stay.

Exactness and bounds:

* Words are ordered by rarity: a fixed-size table of counts over all documents
  (2^22 one-byte counters, broadcast) gives each word's place, ties by the word's hash.
* Lines of equal sets are folded where they are read and again by class, so a
  line that is everywhere is one row a task; only a class's first line goes on.
* Prefix filter: matching sets share a word in their |x| - ceil(t |x|) + 1 rarest;
  only those are shuffled.  A word whose counter is 1 can't be shared.
* Within a word's bucket rows are ordered by size and compared in arrays: length
  filter, positional filter, and a parity map of the words (128 bits, for large sets 256), whose
  differing bits never exceed the sets' symmetric difference.
* A word with over ``full`` rows is dealt out to several buckets in the first round, by the rows'
  hashes, so no cell grows with one word; its rows are compared by neighbourhoods there and count as open.
* Rows out are linear (bounds in ``Limits``): of a row's earlier candidates in a bucket only the
  ``keep`` closest are verified at first.  In a bucket of over ``full`` rows each
  row meets its ``window`` neighbours only.  A class that had more candidates, or
  neighbours that it didn't meet, and wasn't removed, is open.
* Open classes are compared with all rows of their buckets, by 16-bit hashes of
  all words, whose overlap is never below the true one, so what passes is a match
  but for colliding hashes.  Large buckets are dealt out as pairs of groups.
  What is open even then, for collisions alone, is compared without ``keep``.
* Candidates are verified on the words themselves, read again from the texts; fixed-size
  Bloom filters of their places only save work.

Classes are known by 128-bit hashes; words by 64 bits within a pair.

Defined cases: null and empty texts have no lines and stay as they are; null doc_ids come
last; rows that repeat id and text are one document and are treated alike;
within a document the first of two like lines stays; a text of many lines or long
lines costs time in proportion (a line's shuffled prefix grows with its words); an empty
table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import blocks
from corvane.llm.common import Bloom, Workspace, free_names, give_back, map_batches, sequential_segments, text_steps, word_stream

SIMILARITY = 0.8
COUNTER_BITS, BLOCK_BITS, HEAVY_BITS = 22, 16, 16
#: Sets of more words have the wider parity map.
LARGE = 96
#: Documents whose ids are sent out to pick their texts, at most (as a Bloom filter of them counts).
FEW_DOCUMENTS = 4096


@dataclass(frozen=True)
class Limits:
    """Bounds of a step's work; the result doesn't depend on them."""

    #: Earlier candidates of a row in a bucket that are verified at first.
    keep: int = 2
    #: Buckets of more rows are compared by neighbourhoods first, each row with so many before it.
    full: int = 1 << 14
    window: int = 64
    #: A task tells of words (by 16 bits of their hash) that have over one part in so many of its rows, so at most of so many.
    share: int = 1 << 12
    #: Rows of a group of such a bucket, where that leaves classes open.
    group: int = 1 << 13
    #: Lines that a task folds before it deals them out.
    fold: int = 1 << 16
    #: Pairs that are compared at a time.
    pairs: int = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    """Another hash of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _spread(x: np.ndarray) -> np.ndarray:
    """A fixed random-looking 64-bit number for each number."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: The first n bytes of a number.
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _string_hashes(strings: pa.LargeStringArray) -> np.ndarray:
    """Two 64-bit hashes of each string, (n, 2), of eight bytes at a time; for strings of at most eight bytes each is one to one by length."""
    ends = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    data = np.concatenate((np.frombuffer(strings.buffers()[2] or b"", np.uint8)[: ends[-1]], np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the number that begins at each byte
    start, left = ends[:-1].copy(), np.diff(ends)
    one = _spread(left.astype(np.uint64))
    two = _spread(~left.astype(np.uint64))
    which = slice(None)
    while True:
        chunk = eight[start] & _HEAD[np.minimum(left, 8)]
        one[which], two[which] = _spread(one[which] ^ chunk), _spread(two[which] + chunk)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return np.column_stack((one, two))
        start, left = start[more] + 8, left[more] - 8
        which = more if isinstance(which, slice) else which[more]


def distinct_words(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each distinct word (n, 2), the words' codes in the lines, and the lines' offsets.  The lines are lower-cased."""
    flat, offsets = word_stream(lines)
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.large_string())
    return _string_hashes(words) if len(words) else np.zeros((0, 2), np.uint64), coded.indices.to_numpy(), offsets


def word_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the lines (A-Z lower-cased), and the lines' offsets."""
    h, codes, offsets = distinct_words([x.lower() for x in lines])
    return h[codes, 0], offsets


def document_lines(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines of all texts, lower-cased, and each line's text and number."""
    counts = np.array([x.count(b"\n") + 1 for x in texts], np.int64)
    return b"\n".join(texts).lower().split(b"\n") if texts else [], np.repeat(np.arange(len(texts)), counts), sequential_segments(counts)


class LineSets:
    """The word sets of some lower-cased lines, rarest word first; lines without a word are left out."""

    def __init__(self, lines: list[bytes], counters: np.ndarray | None = None):
        h, codes, offsets = distinct_words(lines)
        first = h[:, 0]
        rank = counters[first >> np.uint64(64 - COUNTER_BITS)] if counters is not None else np.zeros(len(h), np.uint8)
        # Places of the distinct words by rarity and hash; the rare tie of the hashes' first bits is settled by a full sort.
        key = rank.astype(np.uint64) << np.uint64(56) | first >> np.uint64(8)
        order = np.argsort(key)
        if (key[order][1:] == key[order][:-1]).any():
            order = np.lexsort((h[:, 1], first, rank))
        place = np.empty(len(order), np.uint64)
        place[order] = np.arange(len(order), dtype=np.uint64)
        tokens = np.sort(np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(offsets)) << np.uint64(32) | place[codes])
        if len(tokens):
            tokens = tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))]
        line = (tokens >> np.uint64(32)).astype(np.int64)
        self.word = order[(tokens & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        self.start = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        #: The line of each set and the number of its words.
        self.line, self.size = line[self.start], np.diff([*self.start, len(line)]).astype(np.int64)
        self.hash, self.rank = h, rank
        #: Two halves of a set's hash.
        self.id, self.id2 = (np.add.reduceat(_mix(h[:, k])[self.word], self.start) if len(line) else np.zeros(0, np.uint64) for k in (0, 1))

    def words(self, index: np.ndarray) -> np.ndarray:
        """64-bit hashes of the words at these places."""
        return self.hash[self.word[index], 0]

    def small(self) -> np.ndarray:
        """16-bit hashes of all words."""
        return (self.hash[:, 1] >> np.uint64(48)).astype(np.uint16)[self.word]


def word_counters(docs: DataFrame) -> np.ndarray:
    """Counters of all words of all documents as logarithms; 0 stands for words met once at most."""
    size = 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            for _, texts in text_steps(b.column(0)):
                h, codes, _ = distinct_words([b"\n".join(texts).lower()])
                np.add.at(total, (h[:, 0] >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), np.bincount(codes, minlength=len(h)))
        for k in range(len(total) // size):
            own = total[k * size : (k + 1) * size]
            at = np.flatnonzero(own)
            yield blocks.batch([k], [blocks.pack([at.astype(np.uint16), own[at].astype(np.uint64)])])

    def add(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for at, n in held:
            total[at] += n.astype(np.int64)
        level = np.where(total > 1, np.round(8 * np.log2(np.maximum(total, 1))), 0)
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(255, level).astype(np.uint8).tobytes()], pa.binary())], names=["block"])

    def numbered(cell_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in cell_rows:
            for cell, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if cell != now and held:
                    yield blocks.batch([now], [next(add(held)).column(0)[0].as_py()])
                    held = []
                now = cell
                held.append(blocks.unpack(block))
        if held:
            yield blocks.batch([now], [next(add(held)).column(0)[0].as_py()])

    dealt = docs.select("text").mapInArrow(count, blocks.SCHEMA).repartition("cell").sortWithinPartitions("cell")
    # 2^(COUNTER_BITS - BLOCK_BITS) rows of 2^BLOCK_BITS bytes.
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for row in dealt.mapInArrow(numbered, blocks.SCHEMA).collect():
        out[row["cell"] * size : (row["cell"] + 1) * size] = np.frombuffer(row["block"], np.uint8)
    return out


def prefix_length(size: np.ndarray, similarity: float) -> np.ndarray:
    return size - np.ceil(np.round(similarity * size, 9)).astype(np.int64) + 1


#: Blocks of classes: what most steps read, all words as 16-bit hashes, and the prefix words.
CLASS_SCHEMA = "head binary, small binary, prefix binary"


class Classes:
    """Columns of line classes: one entry a class, with its first place, all words as 16-bit hashes and the prefix words (0 for one that nobody shares)."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns
        self.id, self.id2, self.known, self.doc, self.key, self.line = (columns[0], columns[1], columns[2], columns[3], columns[4], columns[5])
        self.size, self.n_prefix = columns[6].astype(np.int64), columns[7].astype(np.int64)
        self.small, self.prefix = columns[8], columns[9]
        self.small_start, self.prefix_start = np.cumsum(self.size) - self.size, np.cumsum(self.n_prefix) - self.n_prefix

    def __len__(self) -> int:
        return len(self.id)

    @staticmethod
    def of(sets: LineSets, doc: np.ndarray, known: np.ndarray, key: np.ndarray, number: np.ndarray, similarity: float) -> Classes:
        n_prefix = prefix_length(sets.size, similarity)
        at = np.repeat(sets.start, n_prefix) + sequential_segments(n_prefix)
        prefix = np.where(sets.rank[sets.word[at]] > 0, sets.words(at), np.uint64(0))
        return Classes([sets.id, sets.id2, known.astype(np.uint8), doc, key, number.astype(np.uint64), sets.size.astype(np.uint64), n_prefix.astype(np.uint64), sets.small(), prefix])

    def take(self, order: np.ndarray) -> list[np.ndarray]:
        return [*(x[order] for x in self.columns[:8]), self.small[blocks.ragged_index(self.size, order, self.small_start)], self.prefix[blocks.ragged_index(self.n_prefix, order, self.prefix_start)]]

    def first_places(self) -> np.ndarray:
        """Of entries of the same class, the place of the first by (doc_id, nulls last, line, text)."""
        order = np.argsort(self.id)
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = self.id[order][1:] == self.id[order][:-1]
        again = np.flatnonzero(same[1:] | same[:-1])  # only entries that share their id are compared by the rest
        at = order[again]
        order[again] = at[np.lexsort((self.key[at], self.line[at], self.doc[at], 1 - self.known[at].astype(np.int8), self.id2[at], self.id[at]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.id[order][1:] != self.id[order][:-1]) | (self.id2[order][1:] != self.id2[order][:-1])
        return order[new]

    def parts(self, order: np.ndarray) -> list[bytes]:
        """The entries at these places as a row of CLASS_SCHEMA."""
        *head, small, prefix = self.take(order)
        return [blocks.pack(head), blocks.pack([small]), blocks.pack([prefix])]

    @staticmethod
    def read(batch: pa.RecordBatch) -> Iterator[Classes]:
        """Classes of each row of CLASS_SCHEMA; what the batch has no column of is empty."""
        for row in range(batch.num_rows):
            head, small, prefix = (blocks.unpack(batch.column(name)[row].as_buffer().to_pybytes()) if name in batch.schema.names else [np.zeros(0, np.uint64)] for name in ("head", "small", "prefix"))
            yield Classes([*head, *small, *prefix])

    @staticmethod
    def merged(held: list[list[np.ndarray]]) -> Classes:
        return Classes(blocks.joined(held))

    def place(self) -> np.ndarray:
        return place_hash(self.doc, self.line.astype(np.int64))


def line_classes(docs: DataFrame, counters, similarity: float, work: Workspace, limits: Limits = Limits()) -> DataFrame:
    """Blocks of classes (CLASS_SCHEMA), written."""
    n_cells = np.uint64(blocks.cells(docs.sparkSession))

    def flush(held: list[Classes]) -> Iterator[pa.RecordBatch]:
        if held:
            own = Classes.merged([x.columns for x in held])
            first = own.first_places()
            yield from blocks.deal((own.id[first] % n_cells).astype(np.int32), lambda rows: own.take(first[rows]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            known, doc = pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False), pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
            for i, texts in text_steps(b.column(1)):
                lines, owner, number = document_lines(texts)
                sets = LineSets(lines, counters.value)
                keys = np.array([xxhash.xxh64_intdigest(x, 42) for x in texts], np.uint64).view(np.int64)
                own = owner[sets.line]
                held.append(Classes.of(sets, doc[own + i], known[own + i], keys[own], number[sets.line], similarity))
                n += len(own)
                if n >= limits.fold:
                    yield from flush(held)
                    held, n = [], 0
        yield from flush(held)
        give_back()

    def fold(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        own = Classes.merged(held)
        order = own.first_places()
        for i in range(0, len(order), blocks.BLOCK_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own.parts(order[i : i + blocks.BLOCK_ROWS])], names=["head", "small", "prefix"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return work.write(blocks.by_cell(own.mapInArrow(read, blocks.SCHEMA), fold, CLASS_SCHEMA), "classes", "none")


def place_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One number for a place (null ids as 0), as ``place_column`` has it."""
    return doc.astype(np.int64) ^ line.astype(np.int64) << np.int64(40)


def place_column(doc: str, line: str):
    return F.coalesce(F.col(doc), F.lit(0).cast("long")).bitwiseXOR(F.shiftleft(F.col(line).cast("long"), 40))


class Bucket:
    """Rows of one cell, ordered by word and size."""

    NAMES = ("word", "size", "pos", "map_a", "map_b", "known", "doc", "line", "id", "role")

    def __init__(self, held: list[list[np.ndarray]]):
        *columns, large_c, large_d, small = blocks.joined(held)
        x = dict(zip(self.NAMES, columns, strict=True))
        size = x["size"].astype(np.int64)
        large = size > LARGE
        for name, values in (("map_c", large_c), ("map_d", large_d)):
            x[name] = np.zeros(len(size), np.uint64)
            x[name][large] = values
        key = x["word"].astype(np.uint64) << np.uint64(32) | size.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        for name, values in x.items():
            setattr(self, name, values[order])
        self.size, self.pos = size[order], self.pos.astype(np.int64)
        self.known, self.doc, self.line = self.known.astype(bool), self.doc.astype(np.int64), self.line.astype(np.int64)
        self.n = len(order)
        if len(small):
            self._count(small[blocks.ragged_index(size, order)])

    def _count(self, small: np.ndarray) -> None:
        """All words of a row as 16-bit hash and, for words of one hash, their number."""
        row = np.repeat(np.arange(self.n, dtype=np.uint64), self.size)
        tokens = np.sort(row << np.uint64(16) | small.astype(np.uint64))
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        again = sequential_segments(np.diff([*first, len(tokens)]))
        self.tokens = (tokens & np.uint64(0xFFFF)) << np.uint64(16) | again.astype(np.uint64) & np.uint64(0xFFFF)
        self.token_start = np.cumsum(self.size) - self.size

    def reach(self, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the range of rows of its word whose sizes allow a match."""
        word = self.key & ~np.uint64(0xFFFFFFFF)
        least, most = np.ceil(np.round(similarity * self.size, 9)), np.floor(np.round(self.size / similarity, 9))
        low = np.searchsorted(self.key, word | least.astype(np.uint64))
        return low, np.searchsorted(self.key, word | np.minimum(most, 0xFFFFFFFF).astype(np.uint64), side="right")

    def may_match(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Places of the pairs that pass the positional filter and the parity map."""
        si, sj, pi, pj = self.size[i], self.size[j], self.pos[i], self.pos[j]
        total = si + sj
        need = np.ceil(np.round(similarity / (1 + similarity) * total, 9)).astype(np.int64)
        at = np.flatnonzero(np.minimum(si - pi, sj - pj) >= need - np.minimum(pi, pj))
        return at[self.distance(i[at], j[at]) <= (total - 2 * need)[at]]

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of the rows' parity maps: at most the size of the symmetric difference."""
        a, b = self.map_a[i] ^ self.map_a[j], self.map_b[i] ^ self.map_b[j]
        out = np.bitwise_count(a).astype(np.int64) + np.bitwise_count(b)
        at = np.flatnonzero((self.size[i] > LARGE) & (self.size[j] > LARGE))
        if len(at):
            c, d = self.map_c[i[at]] ^ self.map_c[j[at]], self.map_d[i[at]] ^ self.map_d[j[at]]
            out[at] = sum(np.bitwise_count(m).astype(np.int64) for m in (a[at] ^ c, c, b[at] ^ d, d))
        return out

    def overlap(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common 16-bit hashes of the rows' words: at least as many as common words."""

        def side(rows: np.ndarray) -> np.ndarray:
            n = self.size[rows]
            at = np.repeat(self.token_start[rows], n) + sequential_segments(n)
            return np.repeat(np.arange(len(rows), dtype=np.uint64), n) << np.uint64(32) | self.tokens[at]

        both = np.sort(np.concatenate((side(i), side(j))))
        return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(i))

    def earlier(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether row j's class comes before row i's."""
        out, tie = np.zeros(len(i), bool), np.ones(len(i), bool)
        for x, y in ((~self.known[j], ~self.known[i]), (self.doc[j], self.doc[i]), (self.line[j], self.line[i]), (self.id[j], self.id[i])):
            out |= tie & (x < y)
            tie &= x == y
        return out


PAIR_SCHEMA = "a_doc long, a_line int, a_id long, b_doc long, b_line int, b_id long, more boolean, heavy int, rows long"


def closest(a: np.ndarray, b: np.ndarray, gap: np.ndarray, keep: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each b's pairs the ``keep`` of smallest gap, and the b that had more."""
    order = np.lexsort((gap, b))
    a, b, gap = a[order], b[order], gap[order]
    if keep is None or not len(b):
        return a, b, gap, b[:0]
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    near = sequential_segments(np.diff([*first, len(b)])) < keep
    return a[near], b[near], gap[near], np.unique(b[~near])


def bucket_candidates(held: list[list[np.ndarray]], similarity: float, keep: int | None, full: bool, limits: Limits = Limits()) -> Iterator[pa.RecordBatch]:
    """Pairs (a earlier, b later) of one cell's rows that share a prefix word and pass the filters; ``more`` marks a b that isn't settled by them.

    full: only rows whose role is 1 or 3 are taken as b, only those of role 2 or 3 as a,
    all of a bucket is compared, and by all words.  Else buckets of over limits.full rows are
    compared by neighbourhoods, and named as heavy; so are parts of a word's rows (role 1), which are all open and known as heavy before.
    """
    x = Bucket(held)
    low, high = x.reach(similarity)
    rows = np.arange(x.n)
    open_ = np.zeros(x.n, bool)
    heavy = np.zeros(0, np.int64)
    if full:
        probe = np.flatnonzero(x.role & 1)
    else:
        probe, high = rows, rows
        words, start, n = np.unique(x.word, return_index=True, return_counts=True)
        part = x.role > 0
        heavy = np.flatnonzero((n > limits.full) & ~part[start])
        open_ |= part
        if len(heavy) or part.any():
            cut = (np.repeat(n > limits.full, n) | part) & (low < rows - limits.window)
            open_[cut] = True
            last = np.zeros(x.n + 1, np.int64)  # rows from low to cut are left out by a later row
            np.add.at(last, low[cut], 1)
            np.add.at(last, rows[cut] - limits.window, -1)
            open_ |= np.cumsum(last[:-1]) > 0
            low = np.where(cut, rows - limits.window, low)
        heavy_word, heavy_rows = words[heavy], n[heavy]
    count = (high - low)[probe]
    ends = np.cumsum(count)
    found, few = [np.zeros(0, np.int64)] * 3, max(1, limits.pairs >> 6)
    at = 0
    while at < len(probe):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limits.pairs, side="right")))
        i = np.repeat(probe[at:to], count[at:to])
        j = np.repeat(low[probe[at:to]], count[at:to]) + sequential_segments(count[at:to])
        at = to
        if full:
            ok = np.flatnonzero((x.role[j] & 2 > 0) & (i != j))
            i, j = i[ok], j[ok]
        ok = x.may_match(i, j, similarity)
        i, j = i[ok], j[ok]
        before = x.earlier(i, j)
        if full:
            i, j = i[before], j[before]
            for k in range(0, len(i), few):
                p, q = i[k : k + (few)], j[k : k + (few)]
                common = x.overlap(p, q)
                near = common >= np.round(similarity / (1 + similarity) * (x.size[p] + x.size[q]), 9)
                found = [np.concatenate(y) for y in zip(found, (q[near], p[near], -common[near]), strict=True)]
        else:
            a, b = np.where(before, j, i), np.where(before, i, j)
            found = [np.concatenate(y) for y in zip(found, (a, b, x.distance(a, b)), strict=True)]
        if len(found[0]) > 2 * limits.pairs:
            *found, more = closest(*found, keep)
            open_[more] = True
    a, b, _, more = closest(*found, keep)
    open_[more] = True
    alone = np.setdiff1d(np.flatnonzero(open_), b)

    def ids(k: np.ndarray) -> list[pa.Array]:
        return [pa.array(x.doc[k], mask=~x.known[k]), pa.array(x.line[k].astype(np.int32)), pa.array(x.id[k].view(np.int64))]

    def nothing(n: int) -> list[pa.Array]:
        return [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64())]

    names = [y.split()[0] for y in PAIR_SCHEMA.split(", ")]
    yield pa.RecordBatch.from_arrays([*ids(a), *ids(b), pa.array(open_[b]), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64())], names=names)
    if len(alone):
        yield pa.RecordBatch.from_arrays([*nothing(len(alone)), *ids(alone), pa.array(np.ones(len(alone), bool)), pa.nulls(len(alone), pa.int32()), pa.nulls(len(alone), pa.int64())], names=names)
    if len(heavy):
        at = heavy_word >> np.uint64(32 - HEAVY_BITS)
        yield pa.RecordBatch.from_arrays([*nothing(len(at)), *nothing(len(at)), pa.nulls(len(at), pa.bool_()), pa.array(at.astype(np.int32)), pa.array(heavy_rows.astype(np.int64))], names=names)


def parity_maps(small: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two halves of each set's 128-bit map; of sets over LARGE words also the second half of each half, which makes it 256 bits."""
    start = np.cumsum(size) - size
    spread = _spread(np.arange(1 << 16, dtype=np.uint64))
    place, more = (spread >> np.uint64(57)), spread & np.uint64(1) == 1
    bit = np.uint64(1) << (place & np.uint64(63))
    out = []
    for limit in (None, LARGE):
        own, begin = small, start
        if limit is not None:
            chosen = np.flatnonzero(size > limit)
            own, begin = small[blocks.ragged_index(size, chosen)], np.cumsum(size[chosen]) - size[chosen]
        for half in (0, 1):
            table = np.where((place >> np.uint64(6) == half) & (more | (limit is None)), bit, np.uint64(0))
            out.append(np.bitwise_xor.reduceat(table[own], begin) if len(own) else np.zeros(0, np.uint64))
    return out


def word_rows(classes: DataFrame, limits: Limits = Limits()) -> np.ndarray:
    """Prefix rows of words by the first 16 bits of their hash, where these are over limits.full; else 0.

    Each task counts all of its rows and tells at most limits.share counts, so a count
    lacks at most one part in limits.share of all rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << HEAVY_BITS, np.int64)
        for b in batches:
            for block in b.column(0):
                word = blocks.unpack(block.as_buffer().to_pybytes())[0]
                total += np.bincount((word[word != 0] >> np.uint64(64 - HEAVY_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total > total.sum() // limits.share)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    out = np.zeros(1 << HEAVY_BITS, np.int64)
    # At most 2^HEAVY_BITS rows.
    for row in classes.select("prefix").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > limits.full).collect():
        out[row["slot"]] = row["n"]
    return out


def deal_by_word(classes: DataFrame, parts=None, wanted=None, opened=None, heavy=None, limits: Limits = Limits()) -> DataFrame:
    """Rows of the classes' prefix words, dealt out to cells by word.

    parts: for each 16 bits of a word's hash, to how many buckets its rows go in the first round.
    wanted: a Bloom of words, opened: one of class ids; with them only rows of
    wanted words go, with all words as 16-bit hashes, and those of heavy words
    go to cells by pairs of groups.
    """
    n_cells = np.uint64(blocks.cells(classes.sparkSession))

    def one(own: Classes) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.arange(len(own)), own.n_prefix)
        use = own.prefix != 0
        if wanted is not None:
            use[use] = wanted.value.has(own.prefix[use].view(np.int64))
            some = np.unique(owner[use])  # classes without a wanted word go no further
            if not len(some):
                return
            use = use[blocks.ragged_index(own.n_prefix, some, own.prefix_start)]
            own = Classes(own.take(some))
            owner = np.repeat(np.arange(len(own)), own.n_prefix)
        pos = sequential_segments(own.n_prefix)
        owner, pos, word = owner[use], pos[use], own.prefix[use]
        high = word >> np.uint64(32)
        if wanted is None:
            groups = parts.value[high >> np.uint64(32 - HEAVY_BITS)].astype(np.uint64)
            role = (groups > 1).astype(np.uint8)
            grid = np.where(groups > 1, 1 + _mix(own.id[owner]) % groups, 0)
        else:
            is_open = opened.value.has(own.id.view(np.int64))[owner]
            groups = heavy.value[high >> np.uint64(32 - HEAVY_BITS)].astype(np.int64)
            single = np.flatnonzero(groups == 1)
            dealt = [(single, np.where(is_open[single], 3, 2), np.zeros(len(single), np.int64))]
            many = np.flatnonzero(groups > 1)
            if len(many):
                n = groups[many]
                again, other = np.repeat(many, n), sequential_segments(n)
                n = np.repeat(n, n)
                # The group doesn't follow the rows' order, so that cells are even.
                mine = (_mix(own.id[owner[again]]) % n.astype(np.uint64)).astype(np.int64)
                dealt.append((again, np.where(is_open[again] & (mine == other), 3, 2), 1 + other * n + mine))
                probe = np.flatnonzero(is_open[again] & (mine != other))
                dealt.append((again[probe], np.ones(len(probe), np.int64), 1 + mine[probe] * n[probe] + other[probe]))
            at, role, grid = (np.concatenate(y) for y in zip(*dealt, strict=True))
            owner, pos, word, high, role = owner[at], pos[at], word[at], high[at], role.astype(np.uint8)
        cell = (word + _spread(grid.astype(np.uint64)) * (grid > 0)) % n_cells
        # Rows of one word in different cells of its grid may meet in one cell; the grid's place keeps them apart.
        high = (high ^ _spread(grid.astype(np.uint64)) * (grid > 0)) & np.uint64(0xFFFFFFFF)
        map_a, map_b, map_c, map_d = parity_maps(own.small, own.size)
        rank_large = np.cumsum(own.size > LARGE) - 1

        def pick(rows: np.ndarray) -> list[np.ndarray]:
            k = owner[rows]
            large = rank_large[k[own.size[k] > LARGE]]
            small = own.small[blocks.ragged_index(own.size, k)] if wanted is not None else own.small[:0]
            place = [own.known[k], own.doc[k].view(np.uint64), own.line[k], own.id[k]]
            return [high[rows].astype(np.uint32), own.size[k].astype(np.uint64), pos[rows].astype(np.uint64), map_a[k], map_b[k], *place, role[rows], map_c[large], map_d[large], small]

        yield from blocks.deal(cell.astype(np.int32), pick)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for own in Classes.read(b):
                held.append(own.columns)
                n += len(own)
                if n >= limits.fold >> 1:
                    yield from one(Classes.merged(held))
                    held, n = [], 0
        if held:
            yield from one(Classes.merged(held))
        give_back()

    return classes.mapInArrow(run, blocks.SCHEMA)


def from_classes(classes: DataFrame, fn, schema: str) -> DataFrame:
    """Rows that fn makes of each block of classes (of the columns that it needs)."""
    return map_batches(classes, lambda b: pa.concat_batches([fn(x) for x in Classes.read(b)]), schema)


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once: most share several prefix words."""
    names = [x.split()[0] for x in PAIR_SCHEMA.split(", ")]
    return pairs.groupBy(*names[:6], "heavy").agg(F.max("more").alias("more"), F.max("rows").alias("rows")).select(*names)


def verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(b_doc, b_line, b_id) of the distinct pairs (written) whose sets match, by the words of the lines themselves."""
    sides = [pairs.select(F.col(f"{s}_doc").alias("doc"), F.col(f"{s}_line").alias("line")) for s in "ab"]
    ends = sides[0].unionByName(sides[1]).select(F.coalesce("doc", F.lit(0).cast("long")).alias("doc"), place_column("doc", "line").alias("place"))
    owners, places = (docs.sparkSession.sparkContext.broadcast(Bloom(ends.select(c).distinct(), c)) for c in ("doc", "place"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
            near = np.flatnonzero(owners.value.has(doc))
            for i, texts in text_steps(b.column(1).take(pa.array(near))):
                j = i + len(texts)
                lines, owner, number = document_lines(texts)
                mine = np.flatnonzero(places.value.has(place_hash(doc[near[i:j]][owner], number)))
                sets = LineSets([lines[k] for k in mine.tolist()])
                at = mine[sets.line]
                offsets = np.concatenate(([0], np.cumsum(sets.size))).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sets.words(np.arange(len(sets.word))).view(np.int64)))
                place = [b.column(0).take(pa.array(near[i:j][owner[at]])), pa.array(number[at].astype(np.int32)), pa.array(sets.id.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*place, found], names=["doc", "line", "id", "words"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if owners.value.used() <= FEW_DOCUMENTS:
        # So few that their ids can be sent out; other texts don't leave the scan.
        few = ends.select(F.col("doc").alias("_doc")).distinct()
        own = own.join(F.broadcast(few), F.coalesce("doc_id", F.lit(0).cast("long")) == few["_doc"], "left_semi")
    found = own.mapInArrow(words, "doc long, line int, id long, words array<long>")
    # Rows that repeat an id may hold a line again.
    one = found.groupBy("doc", "line", "id").agg(F.first("words").alias("words"))
    one = one.select(F.struct("doc", "line", "id").alias("at"), "words")
    both = pairs
    for side in "ab":
        both = both.withColumn(side, F.struct(F.col(f"{side}_doc").alias("doc"), F.col(f"{side}_line").alias("line"), F.col(f"{side}_id").alias("id")))
    both = both.select("a", "b")
    for side, name in (("a", "x"), ("b", "y")):
        right = one.select(F.col("at").alias("_at"), F.col("words").alias(name))
        both = both.join(right, both[side].eqNullSafe(right["_at"])).drop("_at")
    common = F.size(F.array_intersect("x", "y"))
    jaccard = common / (F.size("x") + F.size("y") - common)
    return both.where(jaccard >= similarity).select(F.col("b.doc").alias("b_doc"), F.col("b.line").alias("b_line"), F.col("b.id").alias("b_id")).distinct()


B = ("b_doc", "b_line", "b_id")


def _same(left: DataFrame, right: DataFrame):
    return left["b_doc"].eqNullSafe(right["b_doc"]) & (left["b_line"] == right["b_line"]) & (left["b_id"] == right["b_id"])


def kept_lines(docs: DataFrame, similarity: float = SIMILARITY, work: Workspace | None = None, limits: Limits = Limits()) -> DataFrame:
    """doc_id, text_key and the numbers of the lines that stay, of every document that has such lines."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "line-dedup")
    classes = line_classes(docs, spark.sparkContext.broadcast(word_counters(docs)), similarity, work, limits)
    counted = word_rows(classes, limits)
    parts = spark.sparkContext.broadcast(np.maximum(1, -(-counted // limits.full)).astype(np.uint32))
    found = blocks.by_cell(deal_by_word(classes, parts, limits=limits), lambda held: bucket_candidates(held, similarity, limits.keep, False, limits), PAIR_SCHEMA)
    pairs = work.write(distinct_pairs(found), "pairs", "lz4")
    gone = work.write(verified(pairs.where("a_id is not null"), docs, similarity), "gone", "lz4")
    groups = np.maximum(1, -(-counted // limits.group)).astype(np.uint32)
    # At most 2^HEAVY_BITS rows.
    for row in pairs.where("heavy is not null").groupBy("heavy").agg(F.max("rows").alias("rows")).collect():
        groups[row["heavy"]] = max(groups[row["heavy"]], -(-row["rows"] // limits.group))
    heavy = spark.sparkContext.broadcast(groups)
    for turn, keep in enumerate((limits.keep, None)):
        marked = pairs.where("more").select(*B).distinct()
        undecided = work.write(marked.join(gone, _same(marked, gone), "left_anti"), f"open-{turn}", "lz4")
        if undecided.isEmpty():
            break
        opened = spark.sparkContext.broadcast(Bloom(undecided, "b_id"))

        def prefix_of_open(own: Classes, opened=opened) -> pa.RecordBatch:
            use = np.repeat(opened.value.has(own.id.view(np.int64)), own.n_prefix) & (own.prefix != 0)
            return pa.RecordBatch.from_arrays([pa.array(np.unique(own.prefix[use]).view(np.int64))], names=["word"])

        words = from_classes(classes.select("head", "prefix"), prefix_of_open, "word long")
        wanted = spark.sparkContext.broadcast(Bloom(words.distinct(), "word"))
        dealt = deal_by_word(classes, None, wanted, opened, heavy, limits)
        found = blocks.by_cell(dealt, lambda held, keep=keep: bucket_candidates(held, similarity, keep, True, limits), PAIR_SCHEMA)
        pairs = work.write(distinct_pairs(found), f"pairs-{turn}", "lz4")
        more = verified(pairs.where("a_id is not null"), docs, similarity)
        gone = work.write(gone.unionByName(more).distinct(), f"gone-{turn}", "lz4")

    kept = work.write(_kept_by_document(classes, gone, limits), "kept", "lz4")
    work.drop("classes", "pairs", "gone", *(f"{name}-{turn}" for name in ("open", "pairs", "gone") for turn in range(2)))
    return kept


def _kept_by_document(classes: DataFrame, gone: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, text_key and the numbers of the first places of classes that aren't gone.

    Classes that a Bloom filter of the gone ones doesn't know go straight to their
    documents; the others are held against the gone ones themselves.
    """
    spark, classes = classes.sparkSession, classes.select("head")
    n_cells = np.uint64(blocks.cells(spark))
    doubtful = spark.sparkContext.broadcast(Bloom(gone, "b_id"))

    def dealt(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Places (doc, known, text_key, line), dealt out by text."""
        if held:
            doc, known, key, line = blocks.joined(held)
            columns = [known.astype(np.uint8), doc, key, line.astype(np.uint64)]
            yield from blocks.deal((key.view(np.uint64) % n_cells).astype(np.int32), lambda rows: [x[rows] for x in columns])

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for own in Classes.read(b):
                at = ~doubtful.value.has(own.id.view(np.int64))
                held.append([own.doc[at], own.known[at], own.key[at], own.line[at]])
                n += len(own)
                if n >= limits.fold:
                    yield from dealt(held)
                    held, n = [], 0
        yield from dealt(held)

    def places(own: Classes) -> pa.RecordBatch:
        at = doubtful.value.has(own.id.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(own.doc[at], mask=own.known[at] == 0), pa.array(own.line[at].astype(np.int32)), pa.array(own.id[at].view(np.int64)), pa.array(own.key[at])], names=[*B, "text_key"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
            yield from dealt([[doc, pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]])

    def gather(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        known, doc, key, line = blocks.joined(held)
        order = np.lexsort((line, doc, known, key))
        known, doc, key, line = known[order], doc[order], key[order], line[order].astype(np.int32)
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])
        first = np.flatnonzero(new)
        offsets = np.append(first, len(order)).astype(np.int32)
        # A document's lines: bounded by its text.
        yield pa.RecordBatch.from_arrays([pa.array(doc[first], mask=known[first] == 0), pa.array(key[first]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(line))], names=["doc_id", "text_key", "kept"])

    held = from_classes(classes, places, "b_doc long, b_line int, b_id long, text_key long")
    rest = held.join(gone, _same(held, gone), "left_anti").mapInArrow(again, blocks.SCHEMA)
    return blocks.by_cell(classes.mapInArrow(sure, blocks.SCHEMA).unionByName(rest), gather, "doc_id long, text_key long, kept array<int>")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, work: Workspace | None = None, counts: bool = False, limits: Limits = Limits()) -> DataFrame:
    """docs with matching later lines taken out of the text; all columns stay.

    counts: only doc_id, text, n_lines (lines with a word), n_removed and removed_lines (their numbers from 0).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") if counts else docs
    doc, key, kept = free_names(base, "_doc", "_key", "_kept")
    stay = kept_lines(docs, similarity, work, limits).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("kept").alias(kept))
    same = base["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(base["text"]) == F.col(key))
    # The kept lines of a partition are a small part of its texts, so these are looked up there, not sorted.
    held = base.join(stay.hint("shuffle_hash"), same, "left").select(*[base[c] for c in base.columns], kept)
    more = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_lines", T.ArrayType(T.IntegerType()))] if counts else []
    schema = T.StructType([*base.schema.fields, *more])
    at = base.columns.index(next(c for c in base.columns if c.lower() == "text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, removed = [], [], []
        for text, stays in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
            lines, mine = (text or b"").split(b"\n"), set(stays or ())
            worded = [k for k, x in enumerate(lines) if x.strip()]
            gone = [k for k in worded if k not in mine]
            if gone:
                left = set(gone)
                text = b"\n".join([x for k, x in enumerate(lines) if k not in left])
            texts.append(text)
            n_lines.append(len(worded))
            removed.append(gone)
        columns = list(b.columns[:-1])
        columns[at] = pa.array(texts, pa.binary()).cast(columns[at].type)
        if counts:
            columns += [pa.array(n_lines, pa.int64()), pa.array(list(map(len, removed)), pa.int64()), pa.array(removed, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(held, run, schema)
