"""Quality rules with line labelling by a linear-chain conditional random field.

Each text is a sequence of lines; the field marks every line as content or
boilerplate by Viterbi decoding, and a document stays if no base rule fails and the content lines hold
at least the field's share of its word characters.

The field is trained here, on a bounded sample (at most ``TRAIN_DOCS`` labelled
documents, those with the smallest hash of doc_id among the ones of at most ``TRAIN_CHARS``
characters, and ``TRAIN_LINES`` lines of each, spread evenly over the text; all three are parameters).
The table labels documents, not lines, so the lines' labels are latent: they begin as
their document's, lines that look like the other kind are given to it, and the field is
trained on the lines' labels, in turns.  Runs of boilerplate lines spliced into good
documents, and of content lines into bad ones, show it the changes of label.  The share that decides is the one that
tells the sample's good and bad documents apart best.  Nothing else
is sampled: every line of every text is decoded.

Defined cases: null and empty texts have no words, fail the base rule and go;
lines without a word take no part in decoding; a very long text is decoded whole, in time in proportion to its lines; without labels of both kinds no
field is trained and the base rules alone decide; repeated rows are decided row
by row; an empty table gives no rows; other columns are ignored, or kept by
``keep_good`` whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_batches

TRAIN_DOCS, TRAIN_CHARS, TRAIN_LINES = 600, 20_000, 100
#: The share of content that decides if the sample has no say.
CONTENT_SHARE = 0.5
#: Turns of labelling the lines and training, and lines of a spliced run at most.
TURNS, RUN = 2, 5
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
STATES = 2  # 0 boilerplate, 1 content
_SYMBOL = re.compile(r"[#*$%&|<>]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER, _DIGIT, _END, _CODE = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[.!?:;,\"')\]](?=\s|\Z)"), re.compile(r"[{}()=;\[\]_\\/]")
FEATURES = 14


@dataclass
class TextStats:
    """Counts that the base rules use."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def repeated_words(words: list[str], window: int = REPEAT_WINDOW) -> int:
    """Words in windows of so many words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    code: dict[str, int] = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    # Windows get ids by pairs, exactly: the id of a window and the next word, ranked.
    ids = codes[:n].copy()
    for k in range(1, window):
        _, ids = np.unique(ids * len(code) + codes[k : k + n], return_inverse=True)
    often = np.bincount(ids)[ids] > 1
    change = np.zeros(len(words) + 1, np.int64)
    change[:n] += often
    change[window : window + n] -= often
    return int((np.cumsum(change[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[TextStats, list[str]]:
    """The counts, and the lines that have a word."""
    if not text:
        return TextStats(0, 0, 0, 0, 0), []
    words = text.split() if text.isascii() and not _OTHER.search(text) else _WORDS.findall(text)
    lines = [x for x in text.split("\n") if x and _WORDS.search(x)]
    return TextStats(len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words)), lines


#: Control characters that str.split() takes for white space and the word rule doesn't.
_OTHER = re.compile(r"[\x1c-\x1f]")


def line_features(lines: list[str]) -> np.ndarray:
    """One row of features a line; all between 0 and about 1."""
    out, seen = np.zeros((len(lines), FEATURES)), set()
    for i, line in enumerate(lines):
        words = line.split() or [line]
        chars = max(1, sum(map(len, words)))
        n = len(words)
        upper = len(_UPPER.findall(line)) / chars
        out[i] = (
            1.0,
            min(1.0, 8 * len(_SYMBOL.findall(line)) / chars),
            upper,
            upper > 0.5,
            len(_DIGIT.findall(line)) / chars,
            min(1.0, 4 * len(_CODE.findall(line)) / chars),
            line.count("|") / n if n else 0,
            min(1.0, 2 * line.count("!!") / n),
            1 - len(set(words)) / n,
            n < 4,
            min(1.0, n / 40),
            min(2.0, chars / n / 8),
            line in seen,
            bool(_END.search(line[-1:])),
        )
        seen.add(line)
    return out


class LineField:
    """Linear-chain conditional random field with two states."""

    def __init__(self, emit: np.ndarray, step: np.ndarray, share: float = CONTENT_SHARE):
        self.emit, self.step, self.share = emit, step, share  # (STATES, FEATURES), (STATES, STATES), content share that decides

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The most probable states."""
        scores = features @ self.emit.T
        back = np.zeros((len(scores), STATES), np.int8)
        best = scores[0] if len(scores) else None
        a0, a1 = (best.tolist() if best is not None else (0.0, 0.0))
        (s00, s01), (s10, s11) = self.step.tolist()
        rest = scores.tolist()
        for i in range(1, len(rest)):
            x, y = a0 + s00, a1 + s10
            u, v = a0 + s01, a1 + s11
            back[i] = (y > x, v > u)
            a0, a1 = max(x, y) + rest[i][0], max(u, v) + rest[i][1]
        out = np.zeros(len(scores), np.int8)
        if len(scores):
            out[-1] = a1 > a0
            for i in range(len(scores) - 1, 0, -1):
                out[i - 1] = back[i, out[i]]
        return out

    @staticmethod
    def train(sequences: list[np.ndarray], marks: list[np.ndarray], rounds: int = 80, rate: float = 0.3, ridge: float = 1e-4) -> LineField:
        """Gradient ascent (Adam) on the mean log likelihood a line; marks: the lines' labels of each sequence."""
        length = np.array([len(x) for x in sequences])
        top = int(length.max())
        n = len(sequences)
        x, gold = np.zeros((top, n, FEATURES)), np.zeros((top, n), np.int64)
        for i, (s, m) in enumerate(zip(sequences, marks, strict=True)):
            x[: len(s), i], gold[: len(s), i] = s, m
        live = np.arange(top)[:, None] < length[None, :]
        # Both kinds of line weigh the same in total.
        ones = max(1, int((gold == 1)[live].sum()))
        zeros = max(1, int((gold == 0)[live].sum()))
        share = np.array([m.mean() for m in marks])
        weight = 0.5 * (share / ones + (1 - share) / zeros)
        emit, step = np.zeros((STATES, FEATURES)), np.zeros((STATES, STATES))
        moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(step), np.zeros_like(step)]
        onehot = np.eye(STATES)[gold] * live[:, :, None]
        gold_emit = np.einsum("n,tns,tnf->sf", weight, onehot, x, optimize=True)
        gold_step = np.einsum("n,tna,tnb->ab", weight, onehot[:-1], onehot[1:], optimize=True)
        for r in range(1, rounds + 1):
            scores = x @ emit.T
            # Scaled forward and backward sums.
            local = np.exp(scores - scores.max(axis=2, keepdims=True))
            trans = np.exp(step)
            forward = np.empty((top, n, STATES))
            backward = np.ones((top, n, STATES))
            forward[0] = local[0] / local[0].sum(axis=1, keepdims=True)
            for t in range(1, top):
                new = forward[t - 1] @ trans * local[t]
                forward[t] = np.where(live[t, :, None], new / new.sum(axis=1, keepdims=True), forward[t - 1])
            for t in range(top - 2, -1, -1):
                new = (local[t + 1] * backward[t + 1]) @ trans.T
                backward[t] = np.where(live[t + 1, :, None], new / new.sum(axis=1, keepdims=True), 1.0)
            one = forward * backward
            one *= (live * weight)[:, :, None] / one.sum(axis=2, keepdims=True)
            both = forward[:-1, :, :, None] * trans * (local[1:] * backward[1:])[:, :, None, :]
            both *= ((live[1:] * weight) / both.sum(axis=(2, 3)))[:, :, None, None]
            slopes = (gold_emit - np.einsum("tns,tnf->sf", one, x, optimize=True) - ridge * emit, gold_step - both.sum(axis=(0, 1)) - ridge * step)
            for k, (value, slope) in enumerate(zip((emit, step), slopes, strict=True)):
                moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * slope
                moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * slope**2
                value += rate * (moments[2 * k] / (1 - 0.9**r)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**r)) + 1e-8)
        return LineField(emit, step)


def line_scores(sequences: list[np.ndarray], labels: list[int], rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression of lines on their documents' labels, both kinds weighing the same; by Newton's method."""
    x, y = np.concatenate(sequences), np.repeat(labels, [len(s) for s in sequences])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(FEATURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-4 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(FEATURES)
        w += np.linalg.solve(curve, slope)
    return w


def latent_marks(found: np.ndarray, label: int) -> np.ndarray:
    """Marks of a document's lines; a document without a line of its own kind keeps its label on all."""
    return found if (found == label).any() else np.full(len(found), label)


def spliced(sequences: list[np.ndarray], marks: list[np.ndarray], labels: list[int], seed: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each document once more with a run of lines of the other kind from another document."""
    rng = np.random.default_rng(seed)
    runs = {kind: [s[m == kind] for s, m, label in zip(sequences, marks, labels, strict=True) if label == kind] for kind in (0, 1)}
    out, out_marks = [], []
    for s, m, label in zip(sequences, marks, labels, strict=True):
        other = runs[1 - label]
        if other:
            lines = other[rng.integers(len(other))]
            first = rng.integers(len(lines))
            run = lines[first : first + rng.integers(1, RUN + 1)]
            at = rng.integers(len(s) + 1)
            out.append(np.concatenate((s[:at], run, s[at:])))
            out_marks.append(np.concatenate((m[:at], np.full(len(run), 1 - label), m[at:])))
    return out, out_marks


def deciding_share(shares: np.ndarray, labels: np.ndarray) -> float:
    """The share that tells good from bad documents with the fewest errors (both kinds weigh the same), in the middle of the widest range of such shares."""
    edges = np.unique(np.concatenate(([0.0, 1.0], shares)))
    middles = (edges[1:] + edges[:-1]) / 2
    errors = np.array([(shares[labels == 1] < c).mean() + (shares[labels == 0] >= c).mean() for c in middles])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(middles[best[np.argmax((edges[1:] - edges[:-1])[best])]])


def fit_field(sequences: list[np.ndarray], chars: list[np.ndarray], labels: list[int]) -> LineField:
    """The field and its share from documents' line features, the lines' word characters, and the documents' labels."""
    weights = line_scores(sequences, labels)
    marks = [latent_marks((s @ weights > 0).astype(np.int64), label) for s, label in zip(sequences, labels, strict=True)]
    for turn in range(TURNS):
        more, more_marks = spliced(sequences, marks, labels, turn)
        field = LineField.train([*sequences, *more], [*marks, *more_marks])
        decoded = [field.viterbi(s).astype(np.int64) for s in sequences]
        marks = [latent_marks(m, label) for m, label in zip(decoded, labels, strict=True)]
    shares = np.array([(c * m).sum() / c.sum() for c, m in zip(chars, decoded, strict=True)])
    field.share = deciding_share(shares, np.array(labels))
    return field


def word_chars(lines: list[str]) -> np.ndarray:
    """Word characters of each line."""
    return np.array([sum(map(len, _WORDS.findall(x))) for x in lines], np.int64)


def spread_lines(features: np.ndarray, most: int) -> np.ndarray:
    """At most this many lines, spread evenly from the first to the last."""
    return features if len(features) <= most else features[np.linspace(0, len(features) - 1, most).round().astype(np.int64)]


def train_field(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, train_lines: int = TRAIN_LINES) -> LineField | None:
    """The field from the bounded sample of labelled documents; None without both labels."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= train_chars)
    known = known.join(short.select("doc_id"), "doc_id", "left_semi")
    half = train_docs // 2
    taken = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half).collect()]
    if len({r["quality"] for r in taken}) < 2:
        return None
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in taken], "_id long, _quality int")
    # At most train_docs ids; the distinct keeps a repeated row from being collected over and over.
    rows = short.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_quality").alias("quality")).orderBy("doc_id").collect()
    sequences, chars, gold = [], [], []
    for row in rows:
        if lines := text_stats(row["text"])[1]:
            sequences.append(spread_lines(line_features(lines), train_lines))
            chars.append(spread_lines(word_chars(lines), train_lines))
            gold.append(row["quality"])
    return fit_field(sequences, chars, gold) if len(set(gold)) == 2 else None


def judge_text(text: str | None, field: LineField | None) -> tuple[TextStats, bool, float, str]:
    """Counts, verdict, content share and the lines' marks (one of 0 and 1 a line that has a word)."""
    stats, lines = text_stats(text)
    if not lines:
        return stats, False, 0.0, ""
    if field is None:
        marks = np.ones(len(lines), np.int8)
    else:
        marks = field.viterbi(line_features(lines))
    chars = word_chars(lines) if marks.any() and not marks.all() else np.ones(len(lines))
    share = float((chars * marks).sum() / chars.sum())
    return stats, not stats.base_failed and share >= (field.share if field else CONTENT_SHARE), share, "".join(map(str, marks.tolist()))


def quality_verdicts(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, train_lines: int = TRAIN_LINES) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, content_share and line_marks of every document."""
    field = docs.sparkSession.sparkContext.broadcast(train_field(docs, labels, train_docs, train_chars, train_lines))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "line_marks"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            s, kept, share, marks = judge_text(text, field.value)
            rows.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, kept, share, marks))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c)) for c in zip(*rows, strict=True))], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, line_marks string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, train_lines: int = TRAIN_LINES) -> DataFrame:
    """The documents that stay, with all their columns."""
    field = docs.sparkSession.sparkContext.broadcast(train_field(docs, labels, train_docs, train_chars, train_lines))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([judge_text(x, field.value)[1] for x in batch.column("text").to_pylist()]))

    return map_batches(docs, run, docs.schema)
