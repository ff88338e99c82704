"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte spans. Every adjacent pair whose concatenation has a merge rank puts its
left position into the bucket of that rank; a three-level bitmap of 64-bit words over the ranks finds the lowest
non-empty bucket by three find-first-set steps. An entry is stale, and skipped, when the pair at its position has
another rank by then. Each merge costs a constant number of queue steps, so a pre-token of a million bytes takes
about linear time. Within a bucket the leftmost position comes first, which gives the ids of the tiktoken library.

Texts: null and empty texts have no ids and decode to no bytes. Extra columns are kept; the operators replace the
columns ``ids_le`` and ``decoded`` if the input has them. Rows are independent, so ties, repeated rows and empty
tables need no rule.
"""

from __future__ import annotations

import base64
import re
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import extended, slices

#: Longer pre-tokens are encoded without being memoised.
_MEMO_BYTES = 64
#: Pre-tokens that a worker remembers, at about 200 bytes each; beyond them it starts anew.
MEMO = 1_200_000
# Letters, digits and white space up to U+00FF, by Unicode.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACES = "\t-\r \u0085\u00a0"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's lines: base64 of the token, blank, rank. The file is a tokenizer's vocabulary, of bounded size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe(dict):
    """Encodes and decodes texts. As a dict it memoises pre-token -> ids as little-endian 32-bit words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.limit = ranks, MEMO
        top = max(ranks.values(), default=0)
        #: The two lower levels of the bitmap over ranks; a word's bit is set while the bucket or word below isn't empty.
        self.low, self.mid = [0] * (top // 64 + 1), [0] * (top // 4096 + 1)
        self.buckets: dict[int, list[int]] = {}
        self.wide = regex.compile(pattern)
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACES}{_LETTERS}{_DIGITS}]")
        narrow = narrow.replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_DIGITS}]")
        narrow = narrow.replace(r"\s", f"[{_SPACES}]").replace(r"\S", f"[^{_SPACES}]")
        #: The same pattern for texts up to U+00FF, in the faster engine; None where the pattern has other classes.
        self.narrow = None if re.search(r"\\[pP]|\(\?[>i]|[+*?]\+", narrow) else re.compile(narrow)
        self.tokens = {rank: token for token, rank in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. The queue's steps stand in line: calls would cost more than they do."""
        rank_of = self.ranks.get
        rank = rank_of(piece)
        if rank is not None:
            return [rank]
        low, mid, buckets, top, n = self.low, self.mid, self.buckets, 0, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [-1] * (n + 1)  # rank of the pair that starts at a position
        fresh = [(rank, i) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
        while True:
            for rank, i in fresh:
                pair[i] = rank
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    low[rank >> 6] |= 1 << (rank & 63)
                    mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                    top |= 1 << (rank >> 12)
            while top:  # find the first set bit of each level, skip stale entries
                a = (top & -top).bit_length() - 1
                word = mid[a]
                b = a << 6 | (word & -word).bit_length() - 1
                word = low[b]
                bit = word & -word
                rank = b << 6 | bit.bit_length() - 1
                bucket = buckets[rank]
                if len(bucket) > 1:
                    i = heappop(bucket)
                else:
                    i = bucket[0]
                    del buckets[rank]
                    low[b] = word = word ^ bit
                    if not word:
                        mid[a] = word = mid[a] ^ (1 << (b & 63))
                        if not word:
                            top ^= 1 << a
                if pair[i] == rank:
                    break
            else:
                break
            j = after[i]
            k = after[j]
            pair[j] = pair[i] = -1
            after[i] = k
            before[k] = i
            fresh = []
            if k < n and (rank := rank_of(piece[i : after[k]])) is not None:
                fresh.append((rank, i))
            h = before[i]
            if h >= 0:
                pair[h] = -1
                if (rank := rank_of(piece[h:k])) is not None:
                    fresh.append((rank, h))
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i : after[i]]))
            i = after[i]
        return out

    def __missing__(self, word: str) -> bytes:
        piece = word.encode("utf-8", "surrogatepass")
        ids = np.array(self.merge(piece), "<u4").tobytes()
        if len(piece) <= _MEMO_BYTES:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pattern = self.wide
        if self.narrow is not None:
            try:
                text.encode("latin-1")
                pattern = self.narrow
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.__getitem__, pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[int, ByteBpe] = {}


def _coder(shared, pattern: str) -> ByteBpe:
    """One coder per Python worker and vocabulary, so that its memo outlives a task."""
    ranks = shared.value
    key = xxhash.xxh64_intdigest(repr((pattern, len(ranks), sum(ranks.values()), sorted(ranks)[:64])))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = ByteBpe(ranks, pattern)
    return _CODERS[key]


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | columns)


def _run(df: DataFrame, shared, pattern: str, text: str, encode: bool, decode: bool, ids: str, decoded: str, memo: int = MEMO):
    new = {ids: "binary"} if encode else {}
    new |= {decoded: "binary"} if decode else {}
    kept = df.drop(*new)
    schema = extended(kept.schema, ", ".join(f"{name} {kind}" for name, kind in new.items()))

    def run(batches):
        coder = _coder(shared, pattern)
        coder.limit = memo
        for part in slices(batches):
            if encode:
                coded = [coder.encode(t) for t in part.column(text).to_pylist()]
            else:
                coded = [x or b"" for x in part.column(ids).to_pylist()]
            out = {ids: pa.array(coded, pa.binary())} if encode else {}
            if decode:
                out[decoded] = pa.array(map(coder.decode, coded), pa.binary())
            yield _with(part.drop_columns([n for n in out if n in part.schema.names]), **out)

    return df.drop(*(n for n in new if n != text)).mapInArrow(run, schema) if encode else df.mapInArrow(run, schema)


def _shared(df: DataFrame, ranks_path: str):
    return df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids_le") -> DataFrame:
    """Adds the ids of each text as little-endian unsigned 32-bit integers in one binary column."""
    return _run(df, _shared(df, ranks_path), pattern, text, True, False, ids, "decoded")


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids_le", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for (null ids: none)."""
    return _run(df, _shared(df, ranks_path), pattern, "", False, True, ids, decoded)


def round_trip(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids_le", decoded: str = "decoded", memo: int = MEMO
) -> DataFrame:
    """``encode`` then ``decode`` in one pass of one worker, which remembers at most ``memo`` pre-tokens."""
    return _run(df, _shared(df, ranks_path), pattern, text, True, True, ids, decoded, memo)


def digests(df: DataFrame, ids: str = "ids_le", decoded: str = "decoded") -> DataFrame:
    return df.select(
        "doc_id",
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
