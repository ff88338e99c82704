"""Helpers that run inside a task: batches of rows, word splitting, word hashing.

Texts are handled as UTF-8 bytes, because ``bytes.split`` and ``bytes.translate`` run at memory speed and their
white space is exactly ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: Rows that a task holds as Python objects at once; Arrow batches are cut into slices of this many rows.
SLICE = 256

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, and turns the rest into blanks, so that
#: ``split`` afterwards yields the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    return plain_bytes(text).split()


def space_bytes(text: str | None) -> bytes:
    """A text's UTF-8 bytes, of which ``split`` makes the words ``[^\\x20\\x09-\\x0D]+``."""
    return text.encode("utf-8", "surrogatepass") if text else b""


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a text that are hashed at once; longer texts go in parts, cut between words.
PART = 1 << 20


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as texts need them."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            steps = 1 << (n - 1).bit_length()
            both = (self.base, pow(self.base, -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(steps, x, np.uint64)))) for x in both)


def _mixed(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    x ^= length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class RunHash:
    """64-bit hashes of many runs of one sequence of 64-bit numbers, by differences of a running sum."""

    def __init__(self, base: int):
        self.powers = _Powers(base)

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        self.powers.grow(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.powers.up[:n], out=run[1:])
        return _mixed((run[ends] - run[starts]) * self.powers.down[starts], ends - starts)


_IS_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.random.default_rng(64).integers(1, 2**63, 256, dtype=np.uint64)
_of_bytes = RunHash(0xD6E8FEB86659FD93)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``raw.split()``, found without making the words."""
    if len(raw) <= PART:
        return _part_hashes(raw)
    out, start = [], 0
    while start < len(raw):
        end = start + PART
        while end < len(raw) and not _IS_BLANK[raw[end]]:
            end += 1
        out.append(_part_hashes(raw[start:end]))
        start = end
    return np.concatenate(out)


def _part_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(b) + 2, bool)
    np.take(_IS_BLANK, b, out=blank[1:-1])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return _of_bytes(_BYTE[b], edges[::2], edges[1::2])


def plain_bytes(text: str | None) -> bytes:
    """A text's UTF-8 bytes, of which ``split`` makes its plain words."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN) if text else b""


def window_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words (empty if there are fewer words)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _MULTIPLIER
        out += word_hashes[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with further fields behind its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
