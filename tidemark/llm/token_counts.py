"""Token counts by byte-pair merging over a heap and a linked list, without token ids.

A word starts as one symbol a byte, the last one marked as the word's end, in a doubly linked list. A heap holds every
adjacent pair that has a merge rule, by rank and then place; the least is popped again and again, and an entry whose pair
has changed meanwhile is skipped. A word's count is its number of bytes less the merges done: nothing else is emitted.
A word of n bytes takes n log n steps and about 80 n bytes of memory.

Texts fall apart into words as the vocabulary's own normalizer and pre-tokenizer say. Texts of ASCII and Latin-1 letters
are cut by one pattern that says the same (``token_files.splits_words`` checks the file); strings of added tokens inside
a text count as one token each, which is the library's default.

Null and empty texts have no tokens. Rows are independent: ties, repeated rows and empty tables need no rule. Extra
columns stay; a column named like the result is replaced. Very long texts are cut in one task, word by word.
"""

from __future__ import annotations

import json
import re
from array import array
from heapq import heapify, heappop, heappush

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tidemark.llm.token_files import _PIECES, _is_plain, splits_words
from tidemark.llm.words import extended, slices

#: Words whose counts a worker remembers, at about 130 bytes each; beyond them it starts anew.
MEMO = 1_500_000
#: Longer words (UTF-8 bytes) are counted without being remembered, in arrays instead of lists.
_LONG = 256


def _byte_names() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + rest.index(b)) for b in range(256)]


class TokenCounter(dict):
    """Counts tokens of texts. As a dict it remembers word -> count."""

    def __init__(self, tokenizer_json: str):
        super().__init__()
        found = json.loads(tokenizer_json)
        model = found["model"]
        steps = found.get("pre_tokenizer") or {}
        last = (steps.get("pretokenizers") or [steps])[-1].get("type")
        if model.get("type") != "BPE" or last != "ByteLevel" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("counts need a byte-level BPE vocabulary without dropout, subword prefixes and whole-word matches")
        if any(t.get(k) for t in found.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("counts need added tokens that match as they are written")
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        names = _byte_names()
        if any(x not in vocabulary for c in names for x in (c, c + end)):
            raise ValueError("the vocabulary lacks a byte")
        self.inner, self.final = [vocabulary[c] for c in names], [vocabulary[c + end] for c in names]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Rank of a pair of symbols, and the symbol that each rank makes.
        self.rank = {vocabulary[a] << 20 | vocabulary[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        self.split_words = splits_words(tokenizer_json)
        tokenizer = Tokenizer.from_str(tokenizer_json)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        added = sorted((t["content"] for t in found.get("added_tokens") or []), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.byte_of = {c: b for b, c in enumerate(names)}

    def merged(self, word: bytes) -> int:
        """Tokens of one word: its bytes less the merges done."""
        n = len(word)
        if not n:
            return 0
        packed = (lambda x: array("q", x)) if n > _LONG else list
        symbol = packed([*map(self.inner.__getitem__, word[:-1]), self.final[word[-1]]])
        after, before = packed(range(1, n + 2)), packed(range(-1, n))
        rank_of, made, left = self.rank.get, self.made, n
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbol[i] << 20 | symbol[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n or rank_of(symbol[i] << 20 | symbol[j]) != r:
                continue  # the pair at this place has gone or changed
            k, h = after[j], before[i]
            symbol[i], symbol[j] = made[r], -1
            after[i], before[k] = k, i
            left -= 1
            if k < n and (r := rank_of(symbol[i] << 20 | symbol[k])) is not None:
                heappush(heap, r << 32 | i)
            if h >= 0 and (r := rank_of(symbol[h] << 20 | symbol[i])) is not None:
                heappush(heap, r << 32 | h)
        return left

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        count = self.merged(raw)
        if len(raw) <= _LONG:
            if len(self) >= MEMO:
                self.clear()
            self[word] = count
        return count

    def _piece(self, text: str) -> int:
        """Tokens of a text without added tokens, its words cut by the vocabulary's own rules."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        words = (w for w, _ in self.pre_tokenizer.pre_tokenize_str(text))
        return sum(self.merged(bytes(map(self.byte_of.__getitem__, w))) for w in words)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split_words and _is_plain(text):
            return sum(map(self.__getitem__, _PIECES.findall(text.lower())))
        if self.added is None:
            return self._piece(text)
        pieces = self.added.split(text)
        return len(pieces) - 1 + sum(map(self._piece, filter(None, pieces)))


_COUNTERS: dict[int, TokenCounter] = {}


def _counter(shared) -> TokenCounter:
    """One counter per Python worker and vocabulary, so that what it remembers outlives a task."""
    text = shared.value
    key = xxhash.xxh64_intdigest(text)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(text)
    return _COUNTERS[key]


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each text. The vocabulary file is read by the driver and broadcast (a few MB)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in df.columns if c != n_tokens]
    schema = extended(df.select(kept).schema, f"`{n_tokens}` bigint")

    def run(batches):
        counter = _counter(shared)
        for part in slices(batches):
            counts = pa.array(map(counter.count, part.column(text).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), counts], names=[*kept, n_tokens])

    return df.mapInArrow(run, schema)


def sizes(df: DataFrame, limit: int) -> DataFrame:
    """doc_id, bytes, tokens and whether the tokens exceed a limit, for rows that ``count_tokens`` has counted."""
    return df.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
