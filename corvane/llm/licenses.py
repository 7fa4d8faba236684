"""License scans: fuzzy search for short notices.

Texts are reduced to their words (A-Z lower-cased, one space between), so a
notice is a string of words.  A notice that may have ``k`` edits is split into
k + 1 pieces: an occurrence with at most k edits leaves one of them untouched
(pigeonhole), so exact search for the pieces finds every candidate place.  There
the regex library matches the notice with its bounded-error syntax and reports
span and edits.  Three base phrases are searched exactly in the same strings, and
as notices of few edits besides.

Edits may fall anywhere in a notice's frame.  The words that tell licenses apart
(``IDENTITY``) may have one each and must not become another such word, and version
numbers have none, so another license's notice isn't reported as a misspelling.

Defined cases: null and empty texts have no words, no labels and score 0; a
notice counts wherever it begins and ends at word borders; overlapping candidates
of one notice are verified once; a very long text takes time in proportion, however often a notice is in it; repeated rows are scanned row by row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import PLAIN_WORDS, map_batches, text_bytes

#: Phrases whose places are counted exactly, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Wording of short notices as words, label, and edits allowed (characters).
NOTICES = (
    ("licensed under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2 0", "apache-2", 4),
    ("you may not use this file except in compliance with the license", "apache-2", 6),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 6),
    ("licensed under the bsd license", "bsd", 3),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license version 2", "mpl-2", 3),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("creative commons attribution license", "cc-by", 3),
    ("all rights reserved", "all-rights-reserved", 1),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("under the mit license", "mit", 2),
    ("apache license version 2", "apache-2", 2),
    ("cc by nc", "cc-by-nc", 1),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("boost software license version 1 0", "bsl-1", 2),
    ("eclipse public license version 2", "epl-2", 2),
    ("spdx license identifier mit", "mit", 2),
    ("spdx license identifier apache 2 0", "apache-2", 2),
    ("spdx license identifier bsd 3 clause", "bsd", 2),
)
#: The words of the notices that tell licenses apart, and other words that are as near to them as a misspelling.
IDENTITY = frozenset("mit apache bsd gnu lesser affero mozilla attribution noncommercial sharealike cc by nc boost eclipse spdx".split())
OTHER_WORDS = frozenset("bsl mpl epl gpl lgpl agpl isc ms nist ncsa zlib nd sa na no ny be my bye commercial".split()) | IDENTITY


class Notice:
    """One notice with its pieces and its bounded-error pattern."""

    def __init__(self, wording: str, label: str, edits: int):
        self.wording, self.label, self.edits = wording, label, edits
        self.words = wording.split()
        self.numbers = [w for w in self.words if w.isdigit()]
        # Of each word that tells it apart: its place, and what it may look like: with one edit, or run together with a neighbour.
        self.identity = [(i, w, regex.compile("|".join(f"(?:{x}){{e<=1}}" for x in {w, *("".join(self.words[k : k + 2]) for k in (i - 1, i) if k >= 0)}))) for i, w in enumerate(self.words) if w in IDENTITY]
        # k + 1 pieces of nearly equal length cover the wording.
        n = edits + 1
        cuts = [len(wording) * i // n for i in range(n + 1)]
        self.pieces = [(a, wording[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rf"(?e)(?<=^| )(?:{regex.escape(wording)}){{e<={edits}}}(?= |$)")

    def means_it(self, place: list[str]) -> bool:
        """Whether a near place is this notice misspelt: the same version, and each word that tells licenses apart with at most one edit and not another such word."""
        if [w for w in place if w.isdigit()] != self.numbers:
            return False
        for i, word, near in self.identity:
            seen = place[i : i + 1] if len(place) == len(self.words) else [*place, *map("".join, zip(place, place[1:]))]
            if not any(x == word or (x not in OTHER_WORDS and near.fullmatch(x)) for x in seen):
                return False
        return True

    def candidates(self, words: bytes) -> list[tuple[int, int]]:
        """Joined ranges of bytes that hold every occurrence with at most the allowed edits."""
        size, ranges = len(self.wording.encode()), []
        for offset, piece in self.pieces:
            at = words.find(piece)
            while at >= 0:
                ranges.append((max(0, at - offset - self.edits), at - offset + size + self.edits))
                at = words.find(piece, at + 1)
        out: list[tuple[int, int]] = []
        for a, b in sorted(ranges):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def spans(self, words: bytes, borders: Borders) -> list[tuple[int, int, int]]:
        """(first word, word after the last, edits) of the occurrences, left to right without overlap."""
        found = []
        for a, b in self.candidates(words):
            # Ranges are widened to whole words, so borders are seen as in the whole text.
            a = words.rfind(b" ", 0, a) + 1
            end = words.find(b" ", b)
            end = end if end >= 0 else len(words)
            part = words[a:end].decode()
            inner, first = None, borders.before(a)
            for m in self.pattern.finditer(part):
                if any(m.fuzzy_counts) and not self.means_it(m.group().split()):
                    continue
                inner = inner or Borders(np.frombuffer(part.encode("utf-32-le"), "<u4"))
                found.append((first + inner.before(m.start()), first + inner.before(m.start()) + m.group().strip().count(" ") + 1, sum(m.fuzzy_counts)))
        return found


class Borders:
    """Places of the spaces of a text, so that a place's word is found by search instead of by counting from the beginning."""

    def __init__(self, characters: np.ndarray):
        self.characters, self._spaces = characters, None

    def before(self, at: int) -> int:
        """Spaces before this place."""
        if self._spaces is None:
            self._spaces = np.flatnonzero(self.characters == 32)
        return int(np.searchsorted(self._spaces, at))


@lru_cache(maxsize=4)
def _compiled(notices: tuple) -> tuple[Notice, ...]:
    return tuple(Notice(*x) for x in notices)


def normal_words(text: bytes) -> bytes:
    """The words of a text, one space between."""
    return b" ".join(text.translate(PLAIN_WORDS).split())


def scan_text(text: bytes, notices: tuple = NOTICES) -> dict:
    """Words, base places and spans of one text."""
    words = normal_words(text)
    padded = b" " + words + b" "
    borders, padded_borders = Borders(np.frombuffer(words, np.uint8)), Borders(np.frombuffer(padded, np.uint8))
    base: list[tuple[int, str]] = []
    for phrase, label in BASE_PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at = padded.find(needle)
        while at >= 0:
            base.append((padded_borders.before(at), label))
            at = padded.find(needle, at + 1)
    spans = [(first, last, notice.label, edits, 1 - edits / len(notice.wording)) for notice in _compiled(notices) for first, last, edits in notice.spans(words, borders)] if words else []
    return {"n_words": words.count(b" ") + 1 if words else 0, "base": sorted(base), "spans": sorted(spans)}


def license_scan(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """One row a document: counts, labels, score and the spans of fuzzy notices."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("score", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in text_bytes(batch.column(1)):
            found = scan_text(text, notices)
            starts = [x for x, _ in found["base"]]
            base = {x for _, x in found["base"]}
            spans = [dict(zip(("first", "last", "label", "edits", "score"), x, strict=True)) for x in found["spans"]]
            score = 1.0 if base else max((x["score"] for x in spans), default=0.0)
            rows.append((found["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x["label"] for x in spans})), score, spans))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema += ", spans array<struct<first: long, last: long, label: string, edits: int, score: double>>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
