"""Benchmark decontamination: a generalised suffix automaton of test items, matched against streamed texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window is ``window``
consecutive words of an item; an item of fewer words, but at least one, is one window. A text's word inside any
occurrence of a window is hit. Null and empty texts have no words; null and empty items have no window; repeated
items count each, by their ids. Rows are judged one by one, so repeated rows give repeated results, and an empty
table an empty one; without items nothing is hit. Columns of the input that clash with the added ones are replaced.

The automaton is broadcast, as word lists, only if the items have at most ``max_words`` words. More items are dealt
to shards of that size by a hash of the id; each shard is matched in a pass of its own and the spans are merged.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import stored
from tidemark.llm.suffix_automaton import SuffixAutomaton
from tidemark.llm.words import extended, plain_words, slices

WINDOW = 10
#: Words of items that are broadcast at once.
MAX_WORDS = 300_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BITS = 22


class ItemMatcher:
    """Finds the windows of items in word sequences."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.automaton = sam = SuffixAutomaton()
        coded = []
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in plain_words(text)]
            if ids:
                coded.append((item, ids))
                sam.add(ids)
        #: Items by the state of a whole window, and by the state of a whole item of fewer words with its length.
        self.by_window: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, ids in coded:
            v = matched = 0
            for symbol in ids:
                v, matched = self._within(v, matched, symbol)
                if matched == window:
                    self.by_window.setdefault(v, set()).add(item)
            if len(ids) < window:
                self.short.setdefault(v, []).append((len(ids), item))
        #: For each state, the nearest state with a short item on the way to the root, itself included, or 0.
        self.near = [0] * len(sam.link)
        if self.short:
            for v in sorted(range(1, len(sam.link)), key=sam.length.__getitem__):
                self.near[v] = v if v in self.short else self.near[sam.link[v]]
        self.least = min((min(len(ids), window) for _, ids in coded), default=0)
        #: Hashed word pairs of items: what has no run of them can't hold a window of two words or more.
        self.pairs = np.zeros(1 << _BITS, bool)
        for _, ids in coded:
            x = np.array(ids, np.int64)
            self.pairs[self._pair(x[:-1], x[1:])] = True

    def _within(self, v: int, matched: int, symbol) -> tuple[int, int]:
        """The matching statistic after one more symbol, of at most ``window`` symbols: the state of just that suffix."""
        sam = self.automaton
        v, matched = sam.step(v, matched, symbol)
        matched = min(matched, self.window)
        return (sam.at_length(v, matched) if matched else 0), matched

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b) & ((1 << _BITS) - 1)

    def runs(self, ids: np.ndarray):
        """Start and end of the stretches that may hold windows."""
        known = ids >= 0
        ok = known if self.least < 2 else known[:-1] & known[1:] & self.pairs[self._pair(ids[:-1], ids[1:])]
        need = self.least if self.least < 2 else self.least - 1
        if need > 1 and np.count_nonzero(ok) < need:
            return
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= need
        yield from zip(starts[long].tolist(), (ends[long] + (self.least >= 2)).tolist(), strict=True)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged [start, end) spans of hit words, the items that occur, the longest match length."""
        spans, items, longest = [], set(), 0
        if not self.least or len(words) < self.least:
            return spans, items, longest
        ids = np.fromiter(map(self.words.get, words, _minus()), np.int64, len(words))
        sam, window = self.automaton, self.window
        for start, end in self.runs(ids):
            v = matched = u = within = 0
            for at, symbol in enumerate(ids[start:end].tolist(), start + 1):
                v, matched = sam.step(v, matched, symbol)
                u, within = self._within(u, within, symbol)
                longest = max(longest, matched)
                hit = 0
                if within == window:
                    items |= self.by_window[u]
                    hit = window
                short = self.near[u]
                while short:
                    for n, item in self.short[short]:
                        if n <= within:
                            items.add(item)
                            hit = max(hit, n)
                    short = self.near[sam.link[short]]
                if hit:
                    first = at - hit
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, at))
        return spans, items, longest


def _minus():
    while True:
        yield -1


_MATCHERS: dict[tuple, ItemMatcher] = {}


def _matcher(shared, window: int) -> ItemMatcher:
    """The worker's matcher for a broadcast (name, items)."""
    name, items = shared.value
    key = (name, window)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = ItemMatcher(items, window)
    return _MATCHERS[key]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span of word positions."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    kept, end = [], 0
    for a, b in spans:
        kept.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*kept, raw[end:]]).decode("utf-8", "surrogatepass")


_ADDED = "n_words long, n_hit long, longest_match long, items array<string>, hit_spans array<array<int>>, clean_text string"


def _matched(docs: DataFrame, shared, window: int, text: str) -> DataFrame:
    added = [x.strip().split(" ")[0] for x in _ADDED.split(", ")]
    kept = docs.drop(*(c for c in added if c != text))
    schema = extended(kept.schema, _ADDED)

    def run(batches):
        matcher = _matcher(shared, window)
        for part in slices(batches):
            rows = []
            for t in part.column(text).to_pylist():
                words = plain_words(t)
                spans, items, longest = matcher.match(words)
                hit = sum(b - a for a, b in spans)
                rows.append((len(words), hit, longest, sorted(items), spans, without(t, spans) if spans else t))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.string())
            new = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(added, kinds, strict=True))}
            yield pa.RecordBatch.from_pydict({n: part.column(n) for n in part.schema.names} | new)

    return kept.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Adds n_words, n_hit, longest_match, items (sorted as strings), hit_spans (word positions) and clean_text.

    clean_text is the text without hit spans (null where the text is null).
    """
    items = items.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("item_text")).where(
        "item IS NOT NULL AND item_text IS NOT NULL"
    )
    # A word takes two bytes or more with what parts it, so this bounds the words, and the broadcast, without splitting.
    total = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    shards = max(1, math.ceil(total / 2 / max_words))
    spark = docs.sparkSession

    def shared(k: int):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k)
        rows = own.orderBy("item", "item_text").collect()
        return spark.sparkContext.broadcast((uuid.uuid4().hex, [(r[0], r[1]) for r in rows]))

    if shards == 1:
        return _matched(docs, shared(0), window, text)
    return _in_shards(docs, shared, shards, window, text)


def _in_shards(docs: DataFrame, shared, shards: int, window: int, text: str) -> DataFrame:
    """The same with one stored pass a shard. The rows' own columns stand apart in one struct."""
    found = docs.select(
        F.struct("*").alias("row"), F.col(text).alias("text"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("far"),
        F.array().cast("array<string>").alias("of"), F.array().cast("array<array<int>>").alias("spans"),
    )
    for k in range(shards):
        items = shared(k)
        step = _matched(found, items, window, "text")
        found = stored(
            step.select(
                "row", "text", F.col("n_words").alias("words"), F.greatest("far", "longest_match").alias("far"),
                F.array_distinct(F.concat("of", "items")).alias("of"), F.array_sort(F.concat("spans", "hit_spans")).alias("spans"),
            ),
            "item-shard",
        )
        items.unpersist()

    def merged(batches):
        for part in slices(batches):
            rows = []
            for t, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                out = []
                for a, b in spans:
                    if out and out[-1][1] >= a:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                rows.append((sum(b - a for a, b in out), out, without(t, out) if out else t))
            new = {"n_hit": pa.int64(), "hit_spans": pa.list_(pa.list_(pa.int32())), "clean_text": pa.string()}
            kept = {c: part.column(c) for c in part.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(kept | {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(new.items())})

    out = found.mapInArrow(merged, extended(found.drop("text").schema, "n_hit long, hit_spans array<array<int>>, clean_text string"))
    added = [x.strip().split(" ")[0] for x in _ADDED.split(", ")]
    own = {"n_words": F.col("words"), "longest_match": F.col("far"), "items": F.array_sort("of")}
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in added or c == text), *(own.get(c, F.col(c)).alias(c) for c in added if c != text))


def clean(docs: DataFrame, items: DataFrame, max_hit_share: float = 0.5, max_match: int | None = None, **how) -> DataFrame:
    """Removes hit spans from the texts; drops rows whose hit share exceeds max_hit_share or whose longest match
    exceeds max_match words. Returns the columns of docs."""
    text = how.get("text", "text")
    found = decontaminate(docs, items, **how)
    keep = F.col("n_hit") <= max_hit_share * F.col("n_words")
    if max_match is not None:
        keep &= F.col("longest_match") <= max_match
    found = found.where(keep)
    return found.select(*(F.col("clean_text").alias(c) if c == text else F.col(c) for c in docs.columns))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
