"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

A text's lines (split at \\n) that hold a word ``[^\\x20\\x09-\\x0D]+`` form a chain. Each line has yes/no features of
its length, characters and place; Viterbi decoding finds the best labels of the whole chain. The share of words that
lie in content lines decides retention, after two base rules: at least 50 words, and at most half of the words in
3-word windows that the text holds twice or more.

The field is trained here, by gradient ascent on the penalised log-likelihood, on at most ``SAMPLE`` labelled rows
chosen by a hash of the id: lines of rows with quality 1 count as content, lines of rows with quality 0 and lines
equal to an earlier one as boilerplate. Without labelled rows every line is content.

Null and empty texts have no words and fail the base rules. Rows are independent; repeated rows give repeated
results. Columns that the operator adds replace equal names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import extended, slices

#: Rows, and lines of a row, that the field is trained on; rows with more lines are not drawn.
SAMPLE, SAMPLE_LINES = 800, 64
MIN_SHARE = 0.5
_SYMBOLS = b"#*$%&|<>"
# Words of menus, notices and calls to act.
_NOTICES = (
    b"copyright", b"licen", b"rights reserved", b"cookie", b"privacy", b"subscribe", b"click", b"terms of",
    b"log in", b"sign up", b"share this", b"http", b"www.", b"read more",
)
_UPPER, _LETTER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGIT = b"0123456789"
FEATURES = 24


def line_features(line: bytes, words: list[bytes], repeated: bool, first: bool, last: bool) -> list[int]:
    """Indices of the features that hold."""
    n, size = len(words), len(line)
    letters = size - len(line.translate(None, _LETTER))
    upper = size - len(line.translate(None, _UPPER))
    symbols = size - len(line.translate(None, _SYMBOLS))
    digits = size - len(line.translate(None, _DIGIT))
    low, chars = line.lower(), sum(map(len, words))
    tests = (
        n <= 3, 4 <= n <= 9, 10 <= n <= 29, n >= 30, words[-1][-1] in b'.!?"', repeated, 50 * symbols > size, 10 * symbols > size,
        10 * digits > size, 2 * upper > letters > 0, b"!!" in line, any(x in low for x in _NOTICES), chars > 10 * n, chars < 3 * n,
        b"," in line, first, last, first and last, 2 * len(set(words)) < n, 2 * letters < size, b"@" in line, b"|" in line, b"://" in line,
    )
    return [0, *(i for i, t in enumerate(tests, 1) if t)]


def text_lines(text: str | None) -> tuple[list[bytes], list[list[bytes]], list[bool]]:
    """Lines with a word, their words, and whether an earlier line is equal."""
    lines, words, repeated, seen = [], [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        if own := line.split():
            lines.append(line)
            words.append(own)
            repeated.append(line in seen)
            seen.add(line)
    return lines, words, repeated


def chain(lines, words, repeated) -> list[list[int]]:
    last = len(lines) - 1
    return [line_features(x, w, r, i == 0, i == last) for i, (x, w, r) in enumerate(zip(lines, words, repeated, strict=True))]


@dataclass
class LineField:
    """Label 1 is content. emit: feature x label; move: label x next label."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, features: list[list[int]]) -> list[int]:
        """Viterbi."""
        if not features:
            return []
        emit, ((aa, ab), (ba, bb)) = self._rows, self.move.tolist()
        p, q, back = 0.0, 0.0, []
        for i, own in enumerate(features):
            e = f = 0.0
            for k in own:
                e += emit[k][0]
                f += emit[k][1]
            if i:
                pa_, pb, qa, qb = p + aa, q + ba, p + ab, q + bb
                back.append((0 if pa_ > pb else 1, 0 if qa > qb else 1))
                p, q = max(pa_, pb) + e, max(qa, qb) + f
            else:
                p, q = e, f
        labels = [0 if p > q else 1]
        for b in reversed(back):
            labels.append(b[labels[-1]])
        return labels[::-1]

    def __post_init__(self):
        self._rows = self.emit.tolist()


def train(chains: list[list[list[int]]], labels: list[list[int]], rounds: int = 80, penalty: float = 1e-3) -> LineField:
    """Gradient ascent (Adam) on the mean log-likelihood of whole chains, by forward and backward sums."""
    n, steps = len(chains), max(map(len, chains), default=0)
    if not n or not steps:
        return LineField(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    x = np.zeros((n, steps, FEATURES), np.float32)
    y, there = np.zeros((n, steps), int), np.zeros((n, steps), bool)
    for i, (features, own) in enumerate(zip(chains, labels, strict=True)):
        for t, f in enumerate(features):
            x[i, t, f] = 1
        y[i, : len(own)], there[i, : len(own)] = own, True
    flat, total = x.reshape(-1, FEATURES), there.sum()
    gold_emit = np.einsum("ntf,ntl->fl", x, np.eye(2)[y] * there[..., None])
    gold_move = np.zeros((2, 2))
    np.add.at(gold_move, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
    w = np.zeros(FEATURES * 2 + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for r in range(1, rounds + 1):
        emit, move = w[:-4].reshape(FEATURES, 2), w[-4:].reshape(2, 2)
        score = (flat @ emit).reshape(n, steps, 2)
        fore, aft = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        fore[:, 0] = score[:, 0]
        for t in range(1, steps):
            new = np.logaddexp.reduce(fore[:, t - 1, :, None] + move, axis=1) + score[:, t]
            fore[:, t] = np.where(there[:, t, None], new, fore[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = np.logaddexp.reduce(move + (score[:, t + 1] + aft[:, t + 1])[:, None, :], axis=2)
            aft[:, t] = np.where(there[:, t + 1, None], new, 0)
        z = np.logaddexp.reduce(fore[:, -1], axis=1)
        p = np.exp(fore + aft - z[:, None, None]) * there[..., None]
        pair = np.exp(
            fore[:, :-1, :, None] + move + (score[:, 1:] + aft[:, 1:])[:, :, None, :] - z[:, None, None, None]
        ) * there[:, 1:, None, None]
        grad = np.concatenate(((gold_emit - np.einsum("ntf,ntl->fl", x, p)).ravel(), (gold_move - pair.sum((0, 1))).ravel())) / total
        grad -= penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return LineField(w[:-4].reshape(FEATURES, 2).copy(), w[-4:].reshape(2, 2).copy())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", row_id: str = "doc_id") -> LineField:
    """Trains on at most ``sample`` rows that have a quality label; they are collected, which the bound allows. Drawn rows of more
    than ``SAMPLE_LINES`` lines, or of none, are left out, so there may be fewer. Of the texts of one id the least counts."""
    h = F.xxhash64(F.col(row_id).cast("string"))
    # A row label of 0 says that the row as a whole is poor; only rows with a label can be drawn.
    ids = labels.where("quality IS NOT NULL").select(row_id, "quality").orderBy(h, row_id).limit(sample)
    rows = docs.select(row_id, F.col(text).alias("text")).join(F.broadcast(ids), row_id)
    rows = rows.groupBy(row_id, "quality").agg(F.min("text").alias("text"))  # one text a label, however often its id is repeated

    def features(batches):
        for part in slices(batches):
            out = []
            for text_, quality in zip(part.column("text").to_pylist(), part.column("quality").to_pylist(), strict=True):
                lines, words, repeated = text_lines(text_)
                if 0 < len(lines) <= SAMPLE_LINES:
                    out.append((chain(lines, words, repeated), [int(bool(quality) and not r) for r in repeated]))
            yield pa.RecordBatch.from_pydict(
                {"x": pa.array([o[0] for o in out], pa.list_(pa.list_(pa.int32()))), "y": pa.array([o[1] for o in out], pa.list_(pa.int32()))}
            )

    got = rows.mapInArrow(features, "x array<array<int>>, y array<int>").collect()
    got = sorted(((r["x"], r["y"]) for r in got), key=repr)
    return train([x for x, _ in got], [y for _, y in got])


def repeated_window_words(words: list[bytes]) -> int:
    """Words that lie in 3-word windows found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    m = len(ids)
    if m <= 2_000_000:
        code = (x[:-2] * m + x[1:-1]) * m + x[2:]
    else:  # the product would pass 63 bits: number the pairs first
        code = np.unique(x[:-1] * m + x[1:], return_inverse=True)[1]
        code = code[:-1].astype(np.int64) * m + x[2:]
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.concatenate((count[back] > 1, [False, False]))
    twice[1:] |= twice[:-1]  # the window's second word, and with the next line its third
    third = np.concatenate(([False, False], count[back] > 1))
    return int(np.count_nonzero(twice | third))


def measures(text: str | None, field: LineField, min_share: float) -> tuple:
    lines, words, repeated = text_lines(text)
    flat = [w for own in words for w in own]
    n = len(flat)
    if not n:
        symbols = 0
        return 0, 0, symbols, 0, 0, True, 0.0, False
    raw = text.encode("utf-8", "surrogatepass")
    chars = len(b"".join(flat).decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    twice = repeated_window_words(flat)
    failed = n < 50 or 100 * twice > 50 * n
    labels = field.decode(chain(lines, words, repeated))
    share = sum(len(own) for own, label in zip(words, labels, strict=True) if label) / n
    return n, chars, symbols, sum(repeated), twice, failed, share, not failed and share >= min_share


_COLUMNS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("content_share", "double"), ("kept", "boolean"),
)


def judge(docs: DataFrame, field: LineField, min_share: float = MIN_SHARE, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kept = docs.drop(*(c for c, _ in _COLUMNS if c != text))
    schema = extended(kept.schema, ", ".join(f"{c} {kind}" for c, kind in _COLUMNS))
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches):
        for part in slices(batches):
            rows = [measures(t, shared.value, min_share) for t in part.column(text).to_pylist()]
            new = {c: pa.array([r[i] for r in rows], kinds[k]) for i, (c, k) in enumerate(_COLUMNS)}
            yield pa.RecordBatch.from_pydict({n: part.column(n) for n in part.schema.names} | new)

    return kept.mapInArrow(run, schema)
