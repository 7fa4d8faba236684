"""Exact, cached encoding with public tokenizers.

The library spends most of its time on alignment and on words it has met before.
Texts are therefore cut where the tokenizer itself always cuts, each distinct
piece is encoded once by the library's model, and its ids are kept as packed
bytes in a cache of bounded size.  Some megabytes of text are cut and put together at
a time, in arrays, so that a piece is looked up once for all its places in them.  Anything outside the plain alphabet that the
cutting rules are proven for goes through the library's whole ``encode``, and so does a text that holds the string of an added token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.llm.common import STEP_BYTES, sequential_segments, steps

#: Chunks held by one generation of a worker's cache; two generations are held at most.
CACHE_PIECES = 400_000

#: Characters for which the cutting rules below are known to agree with the tokenizers':
#: visible ASCII, and the letters of Latin-1 and Latin Extended A/B (without U+0130, whose lower case has two characters).
_PLAIN = "!-~À-ÖØ-öø-įı-ɏ"
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_NOT_PLAIN = re.compile(f"[^{_PLAIN}]")
_NOT_PLAIN_LINES = re.compile(f"[^{_PLAIN}\n]")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_BYTE_PIECE = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")
_WORD_PIECE = re.compile(f"'(?:[sdmt]|ll|ve|re)|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+")


def _even_spaced(text: str) -> bool:
    """Whether all white space is one space or newline between two other characters."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return text.replace("\n", "").isprintable() or not _OTHER_SPACE.search(text)


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class _Recent(dict):
    """piece -> packed ids, of bounded size: when full, the entries used since then are carried over on demand."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class _Pieces(_Recent):
    """Pieces as the pre-tokenizer cuts them; the library's model encodes each."""

    def __init__(self, model, packed: list[bytes], size: int = CACHE_PIECES // 4):
        super().__init__(size)
        self.model, self.packed, self.alphabet = model, packed, _byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            mapped = piece.replace(" ", self.alphabet[32]) if piece.isascii() and "\n" not in piece else piece.encode().decode("latin-1").translate(self.alphabet)
            packed = self.packed
            ids = b"".join([packed[t.id] for t in self.model.tokenize(mapped)])
        return self.keep(piece, ids)


class _Chunks(_Recent):
    """Chunks of a text, cut at single spaces; ``cut`` gives a chunk's pieces, ``whole`` encodes what isn't plain.

    Words of letters are kept, and what went through the whole encode.  A word with a stop, or words on both sides of a
    line's end, are put together from their parts; ``after`` has the chunks that begin a line.
    """

    def __init__(self, pieces, cut, whole, plain, prefix: str | None = None, size: int = CACHE_PIECES):
        super().__init__(size)
        self.tokenize, self.packed, self.alphabet = pieces.model.tokenize, pieces.packed, pieces.alphabet
        self.lower, self.prefix = prefix is None, prefix or ""
        self.pieces, self.cut, self.whole, self.plain = pieces, cut, whole, plain
        self.after: _Chunks = self

    def one(self, word: str) -> bytes:
        """ids of letters alone, which are one piece and seldom met in another chunk."""
        if self.lower:
            word = word.lower()
        found = self.tokenize(self.prefix + (word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)))
        packed = self.packed
        return packed[found[0].id] if len(found) == 1 else b"".join([packed[t.id] for t in found])

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = self.older.get(chunk)
            if ids is None:
                ids = self.one(chunk) if chunk.isascii() or self.plain(chunk) else self.whole(chunk)
            return self.keep(chunk, ids)
        if chunk[-1:] in _STOPS and chunk[:-1].isalpha() and (chunk.isascii() or self.plain(chunk)):
            return self[chunk[:-1]] + self.pieces[chunk[-1]]
        if "\n" in chunk:
            first, *others = chunk.split("\n")
            end = self.pieces["\n"]
            return self[first] + b"".join([end + self.after[x] for x in others])
        if self.plain(chunk):
            return b"".join(map(self.pieces.__getitem__, self.cut(chunk)))
        ids = self.older.get(chunk)
        return self.keep(chunk, self.whole(chunk) if ids is None else ids)


#: Marks that are a piece of their own behind a word.
_STOPS = frozenset((",", "."))


class Encoder:
    """ids of whole texts as little-endian bytes; dtype is uint16 where the vocabulary allows, else uint32."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes out of a text before it cuts it.
        self.added = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content)
        #: Those that it looks for in the normalized text are looked for in any case.
        self._added_normal = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values() if x.content and x.normalized) or "(?!)", re.IGNORECASE)
        self._any_normal = any(x.content and x.normalized for x in self.tokenizer.get_added_tokens_decoder().values())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._model = self.tokenizer.model
        said = str(self.tokenizer.pre_tokenizer)
        words = self._model.end_of_word_suffix is not None
        #: Only the two families whose cutting rules are written down here take the cached path.
        if words and "Lowercase" in str(self.tokenizer.normalizer) and "Removed" in said:
            self.kind = "words"
        elif not words and said.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in said and self.tokenizer.normalizer is None:
            self.kind = "bytes"
        else:
            self.kind = "other"
        every = np.arange(self.tokenizer.get_vocab_size(), dtype=self.dtype).tobytes()
        pieces = _Pieces(self._model, [every[i : i + self.dtype.itemsize] for i in range(0, len(every), self.dtype.itemsize)])
        if self.kind == "words":
            self._chunks = _Chunks(pieces, lambda x: _WORD_PIECE.findall(x.lower()), self._whole, lambda x: not _NOT_PLAIN.search(x))
        elif self.kind == "bytes":
            self._chunks = _Chunks(pieces, lambda x: _BYTE_PIECE.findall(" " + x), lambda x: self._whole(" " + x), lambda x: not _NOT_PLAIN_LINES.search(x), pieces.alphabet[32])
            self._heads = _Chunks(pieces, _BYTE_PIECE.findall, self._whole, lambda x: not _NOT_PLAIN_LINES.search(x), "")
            self._chunks.after = self._heads

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _has_added(self, text: str) -> bool:
        return any(x in text for x in self.added) or self._any_normal and bool(self._added_normal.search(text))

    def _is_plain(self, text: str) -> bool:
        """Whether the text may be cut at its spaces."""
        return not self._has_added(text) and (self.kind == "words" or self.kind == "bytes" and _even_spaced(text))

    def encode(self, text: str | None) -> bytes:
        """Equal to the packed ids of ``tokenizer.encode(text, add_special_tokens=False)``; null is empty."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None], limit: int = STEP_BYTES) -> list[bytes]:
        """``encode`` of each text; each distinct chunk of some texts is looked up once, and ids are put together in arrays."""
        out: list[bytes] = [b""] * len(texts)
        cut = []
        for i, text in enumerate(texts):
            if text:
                if self._is_plain(text):
                    cut.append(i)
                else:
                    out[i] = self._whole(text)
        for a, b in steps([len(texts[i]) for i in cut], limit):
            for i, ids in zip(cut[a:b], self._cut_ids([texts[i] for i in cut[a:b]]), strict=True):
                out[i] = ids
        return out

    def _cut_ids(self, texts: list[str]) -> list[bytes]:
        if self.kind == "words":
            # White space only separates here and is never part of a piece.
            heads, rest = [b""] * len(texts), [x.replace("\n", " ") for x in texts]
        else:
            # A single space between two other characters always begins a piece.
            parts = [x.partition(" ") for x in texts]
            heads, rest = [self._heads[x] for x, _, _ in parts], [tail if gap else None for _, gap, tail in parts]
        lists = pc.split_pattern(pa.array(rest, pa.large_string()), " ")
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        found = list(map(self._chunks.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        ids, starts, codes = np.frombuffer(b"".join(found), self.dtype), np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        taken = sizes[codes]
        flat = ids[np.repeat(starts[codes], taken) + sequential_segments(taken)]
        # Ids before each text's first chunk.
        before = np.concatenate(([0], np.cumsum(taken)))[np.concatenate(([0], np.cumsum(lengths)))]
        return [head + flat[a:b].tobytes() for head, a, b in zip(heads, before, before[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batch: pa.RecordBatch, enc: Encoder, end: bytes) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, packed ids with the end id) of a batch of (doc_id, text), some rows at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    for a, b in steps(sizes):
        part = batch.slice(a, b - a)
        for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode_many(part.column(1).to_pylist()), strict=True):
            yield doc_id, ids + end


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
