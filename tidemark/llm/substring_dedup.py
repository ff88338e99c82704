"""Substring dedup: suffix automata of reference shards, matching statistics, removal of repeated spans.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``window`` consecutive words of one document. A word goes
if a window that covers it occurs earlier: in a document of smaller id, or in the same one at an earlier start.
Windows are judged on the input.

The reference is the corpus itself, so its automata cannot all be sent to all documents. They are sharded by content:

* Each window has an *anchor*, the least hash (of 48 bits) among its runs of two fifths of its words. Equal windows
  have equal anchors, so whatever repeats a window meets it in the shard of that anchor. Windows in a row with one
  anchor form a *piece* (of at most 32 windows), told by its anchor and a 64-bit hash of its words.
* Anchors found in one document only are dropped by a count that is combined on the map side.
* Equal pieces are reduced to their first occurrence, again on the map side, so a passage in a third of all documents
  reaches its shard once; all its later occurrences go. Only anchors with several different pieces need an automaton,
  and only the first occurrences of those pieces are fetched from the texts. Where an anchor has more than ``hot``
  pieces, no automaton is built: each of their windows is told by its anchor and a 64-bit hash of all its words, and an
  aggregate combined on the map side finds its first occurrence. So no shard holds more than ``hot`` pieces.
* In a shard, pieces stream in document order against the generalised suffix automaton of the pieces before them; a
  matching statistic of a whole window marks it. The piece is then added to the automaton if it brought anything new.

Within a document, repeats are found where the text is. Words in the automaton are told apart by themselves.

What very many documents share is dealt evenly: the join with the shared anchors can be split by Spark, since both of its
sides are plain exchanges, and the pieces of anchors in ``COMMON`` rows or more are salted where they meet their verdicts.
Rows without an id are told apart by a hash of their texts wherever rows are gathered.

Null texts have no words; very long ones are cut whole. Null ids come first, as one document. Rows with one id count as one
document: they lose nothing to one another (each still loses what it repeats itself), so repeated rows get the same result. Only the id and text columns are read.
Empty tables give empty ones.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import stored
from tidemark.llm.suffix_automaton import SuffixAutomaton
from tidemark.llm.words import RunHash, extended, slices, space_bytes, window_hashes, word_hashes

WINDOW = 20
#: Different pieces of an anchor from which its windows are dealt one by one.
HOT = 1000
#: Rows from which an anchor's pieces are salted, over so many tasks.
COMMON, SALTS = 1000, 16
_LONGEST = 32
#: Hashes of runs of words, from the words' hashes.
piece_hashes = RunHash(0x9E3779B97F4A7C15)


def _running_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Windows:
    """The windows of a sequence of words: their anchors, which of them occur earlier in it, and the pieces of the rest."""

    def __init__(self, raw: bytes, window: int):
        self.window, self.hashes = window, word_hashes(raw)
        self.n = max(0, len(self.hashes) - window + 1)
        if not self.n:
            return
        k = max(1, 2 * window // 5)
        runs = window_hashes(self.hashes, k)
        low = _running_min(runs, window - k + 1)
        anchors = (low >> np.uint64(16)).view(np.int64)  # 48 bits tell anchors apart, and take less room on their way
        new = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        self.anchors, self.new = anchors, new
        self.distinct = np.unique(anchors[new])
        self.again = np.zeros(self.n, bool)
        places = np.zeros(len(runs), bool)  # where an anchor of some window stands
        for o in range(window - k + 1):
            places[o : o + self.n] |= runs[o : o + self.n] == low
        if np.count_nonzero(places) > len(self.distinct):  # else no anchor stands twice, so no window comes twice
            self.again[:] = True
            self.again[np.unique(window_hashes(self.hashes, window), return_index=True)[1]] = False

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, windows, anchor and hash of the stretches of windows with one anchor that are new in this text."""
        again = self.again
        turn = np.flatnonzero(np.diff(again)) + 1 if again.any() else self.new[:0]
        cut = np.union1d(self.new, turn) if len(turn) else self.new
        size = np.diff(cut, append=self.n)
        if size.max() > _LONGEST:
            cut = np.union1d(cut, np.concatenate([np.arange(c, c + m, _LONGEST) for c, m in zip(cut[size > _LONGEST].tolist(), size[size > _LONGEST].tolist(), strict=True)]))
            size = np.diff(cut, append=self.n)
        fresh = ~again[cut]
        start, size = cut[fresh], size[fresh]
        return start, size, self.anchors[start], piece_hashes(self.hashes, start, start + size + self.window - 1).view(np.int64)


def _row(part: pa.RecordBatch, rows) -> dict:
    """The columns that tell a row, doc and t, repeated as rows says."""
    at = pa.array(rows, pa.int32())
    return {c: part.column(c).take(at) for c in ("doc", "t")}


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc, t, anchor), distinct within a row."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            found = [w.distinct if (w := Windows(space_bytes(t), window)).n else np.zeros(0, np.int64) for t in part.column("text").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_pydict(_row(part, rows) | {"anchor": pa.array(np.concatenate(found))})

    return docs.mapInArrow(run, f"doc {kind}, t int, anchor bigint")


def _lists(column: pa.ListArray, *fields: str):
    """For each row of a list of structs, or of numbers, its part as numpy arrays; null lists are empty."""
    ends = column.offsets.to_numpy()
    values = [column.values.field(f).to_numpy(zero_copy_only=False) for f in fields] if fields else [column.values.to_numpy()]
    for i in range(len(column)):
        yield tuple(v[ends[i] : ends[i + 1]] for v in values)


def _pieces(docs: DataFrame, window: int) -> DataFrame:
    """The pieces of rows (doc, t, text, anchors, common) with one of the anchors: doc, t, start, n, anchor, a (the piece's
    hash) and whether the anchor is a common one."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            found = []
            lists = zip(_lists(part.column("anchors")), _lists(part.column("common")), strict=True)
            for text, ((shared,), (common,)) in zip(part.column("text").to_pylist(), lists, strict=True):
                own = Windows(space_bytes(text), window)
                if own.n:
                    arrays = own.pieces()
                    keep = np.isin(arrays[2], shared)
                    found.append([*(x[keep] for x in arrays), np.isin(arrays[2][keep], common)])
                else:
                    found.append([np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)])
            rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            start, n, anchor, a, common = (np.concatenate([f[i] for f in found]) for i in range(5))
            own = {"start": start.astype(np.int32), "n": n.astype(np.int32), "anchor": anchor, "a": a, "common": common}
            yield pa.RecordBatch.from_pydict(_row(part, rows) | {c: pa.array(x) for c, x in own.items()})

    return docs.mapInArrow(run, f"doc {kind}, t int, start int, n int, anchor bigint, a bigint, common boolean")


def _fetched(docs: DataFrame, window: int, cut: bool = False) -> DataFrame:
    """The words of the pieces listed in rows (doc, text, first): anchor, a, doc, start and words. With ``cut`` each window of
    the pieces instead: anchor, a, at (its place in the piece), doc, start and word_hash, of all its words."""
    kind = docs.schema["doc"].dataType.simpleString()
    kinds = {"anchor": pa.int64(), "a": pa.int64(), "start": pa.int32()} | ({"at": pa.int32(), "word_hash": pa.int64()} if cut else {"words": pa.binary()})

    def run(batches):
        for part in slices(batches):
            out = {c: [] for c in ("row", *kinds)}
            listed = _lists(part.column("first"), "start", "n", "anchor", "a")
            for row, (text, own) in enumerate(zip(part.column("text").to_pylist(), listed, strict=True)):
                words = space_bytes(text).split()
                for start, n, anchor, a in zip(*(x.tolist() for x in own), strict=True):
                    piece = words[start : start + n + window - 1]
                    # Where an id is repeated with other texts, the piece is in one of them only.
                    if len(piece) < n + window - 1 or piece_hashes(word_hashes(b" ".join(piece)), np.zeros(1, np.int64), np.array([len(piece)])).view(np.int64)[0] != a:
                        continue
                    if cut:
                        for at in range(n):
                            told = xxhash.xxh64_intdigest(b" ".join(piece[at : at + window])) - (1 << 63)
                            for c, v in zip(out, (row, anchor, a, start + at, at, told), strict=True):
                                out[c].append(v)
                    else:
                        for c, v in zip(out, (row, anchor, a, start, b" ".join(piece)), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict({"doc": part.column("doc").take(pa.array(out["row"], pa.int32()))} | {c: pa.array(out[c], t) for c, t in kinds.items()})

    rest = "at int, word_hash bigint" if cut else "words binary"
    return docs.mapInArrow(run, f"doc {kind}, anchor bigint, a bigint, start int, {rest}")


def repeated_windows(pieces: list[list[bytes]], window: int, documents: list | None = None) -> list[int]:
    """For pieces in order, a bit mask of each one's windows that a piece of an earlier document holds. By default each
    piece is a document of its own; else equal documents stand together."""
    if len(pieces) < 2:
        return [0] * len(pieces)
    sam, masks, waiting = SuffixAutomaton(), [], []
    for at, words in enumerate(pieces):
        if waiting and (documents is None or documents[at] != documents[at - 1]):
            for new in waiting:
                sam.add(new)
            waiting = []
        v = matched = mask = 0
        for i, word in enumerate(words):
            v, matched = sam.step(v, matched, word)
            if matched >= window:
                mask |= 1 << (i - window + 1)
        masks.append(mask)
        if mask != (1 << (len(words) - window + 1)) - 1:
            waiting.append(words)
    return masks


def _judged(fetched: DataFrame, window: int) -> DataFrame:
    """Streams the shards, whose pieces stand together in order: anchor, a and the mask of each piece's repeated windows."""
    dealt = fetched.repartition("anchor").sortWithinPartitions("anchor", "doc", "start")

    def rows(batches):
        for part in slices(batches, 1024):
            yield from zip(*(part.column(c).to_pylist() for c in ("anchor", "a", "words", "doc")), strict=True)

    def run(batches):
        out = []
        for _, own in groupby(rows(batches), key=lambda r: r[0]):
            own = list(own)
            masks = repeated_windows([r[2].split(b" ") for r in own], window, [r[3] for r in own])
            out += [(r[0], r[1], m) for r, m in zip(own, masks, strict=True) if m]
            if len(out) > 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("anchor", "a", "mask"))})

    return dealt.mapInArrow(run, "anchor bigint, a bigint, mask bigint").groupBy("anchor", "a").agg(F.bit_or("mask").alias("mask"))


def _judged_windows(cut: DataFrame) -> DataFrame:
    """The same for windows one by one: a window is repeated if the first with its words is in another document."""
    # Dealt by piece, so evenly; the aggregate and the join both read this exchange.
    cut = cut.repartition("anchor", "a")
    told = ["anchor", "word_hash"]
    first = cut.groupBy(*told).agg(F.min(F.struct("doc")).alias("first"))  # a null id is the least
    again = cut.join(first, told).where(~F.col("doc").eqNullSafe(F.col("first.doc")))
    return again.groupBy("anchor", "a").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))


def _removed(docs: DataFrame, window: int) -> DataFrame:
    """docs with n_words, n_removed and kept_text, from ``out``: structs (start, n, a, mask) of each row's pieces."""
    schema = extended(docs.drop("out", "t").schema, "n_words long, n_removed long, kept_text string")
    bits = np.arange(_LONGEST)

    def run(batches):
        for part in slices(batches):
            rows = []
            for text, marks in zip(part.column("text").to_pylist(), _lists(part.column("out"), "start", "n", "a", "mask"), strict=True):
                raw = space_bytes(text)
                own, words = Windows(raw, window), raw.split()
                n = len(words)
                stay = None
                if own.n:
                    repeated = own.again
                    if len(marks[0]):
                        start, size, a, mask = (x.astype(np.int64) for x in marks)
                        inside = start + size <= own.n
                        start, size, a, mask = start[inside], size[inside], a[inside], mask[inside]
                        true = piece_hashes(own.hashes, start, start + size + window - 1).view(np.int64) == a
                        on = (mask[:, None] >> bits & 1).astype(bool) & (bits < size[:, None]) & true[:, None]
                        repeated[(start[:, None] + bits)[on]] = True
                    at = np.flatnonzero(repeated)
                    if len(at):
                        gone = np.zeros(n + 1, np.int32)
                        gone[at] += 1
                        gone[at + window] -= 1
                        stay = np.cumsum(gone[:-1]) == 0
                kept = words if stay is None else [words[i] for i in np.flatnonzero(stay).tolist()]
                rows.append((n, n - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            new = {c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate((("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())))}
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names if c not in ("out", "t")} | new)

    return docs.mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, hot: int = HOT, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """row_id, text, n_words, n_removed and kept_text (the words that stay, joined by one blank) of every row."""
    if window < 2:
        raise ValueError("a window has at least two words")
    rows = docs.select(F.col(row_id).alias("doc"), F.when(F.col(row_id).isNull(), F.pmod(F.xxhash64(text), F.lit(1 << 16))).cast("int").alias("t"), F.col(text).alias("text"))
    row = ["doc", "t"]

    def with_texts(some: DataFrame, how: str = "inner") -> DataFrame:
        same = rows["doc"].eqNullSafe(some["doc"]) & rows["t"].eqNullSafe(some["t"])
        return rows.join(some, same, how).select(*(rows[c] for c in rows.columns), *(some[c] for c in some.columns if c not in row))

    anchors = _anchors(rows, window)
    # Stored, so that the join with it has two plain exchanges, of which Spark can split the one that is skewed.
    shared = stored(anchors.groupBy("anchor").agg(F.count("*").alias("rows")).where("rows >= 2").select("anchor", (F.col("rows") >= COMMON).alias("often")), "shared-anchors")
    own = anchors.join(shared, "anchor").groupBy(*row).agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("often"), F.col("anchor"))).alias("common"))
    # The texts are shuffled by id once: this exchange serves all joins with them.
    pieces = _pieces(with_texts(own), window)
    # A piece comes once in a document, so the least id tells its first occurrence.
    null = F.col("doc").isNull()
    first = pieces.groupBy("anchor", "a").agg(
        F.min("doc").alias("least"), F.min_by("start", "doc").alias("least_start"), F.min(F.when(null, F.struct("t", "start"))).alias("none"),
        F.max("n").alias("n"), F.count("*").alias("times"), F.bool_or("common").alias("common"),
    )
    known = F.col("none").isNull()
    first = first.select("anchor", "a", F.when(known, F.col("least")).alias("first"), F.when(known, F.col("least_start")).otherwise(F.col("none.start")).alias("start"), F.col("none.t").alias("t"), "n", "times", "common")
    # Counted by an aggregate and joined, not by a window, so that no task holds all pieces of a frequent anchor.
    several = first.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds >= 2")
    kinds = first.join(several, "anchor")

    def fetch(some: DataFrame) -> DataFrame:
        return with_texts(some.groupBy(F.col("first").alias("doc"), "t").agg(F.collect_list(F.struct("start", "n", "anchor", "a")).alias("first")))

    masks = _judged(_fetched(fetch(kinds.where(F.col("kinds") <= hot)), window), window)
    masks = masks.unionByName(_judged_windows(_fetched(fetch(kinds.where(F.col("kinds") > hot)), window, cut=True)))
    verdict = first.join(masks, ["anchor", "a"], "left").where("times >= 2 OR mask IS NOT NULL")
    salts = F.when(F.col("common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    verdict = verdict.select("anchor", "a", "first", F.coalesce("mask", F.lit(0)).cast("bigint").alias("mask"), F.explode(salts).alias("salt"))
    salted = pieces.withColumn("salt", F.when(F.col("common"), F.pmod(F.xxhash64("doc", "t"), F.lit(SALTS))).otherwise(0).cast("int"))
    marks = salted.join(verdict, ["anchor", "a", "salt"]).select(*row, "start", "n", "a", F.when(F.col("doc").eqNullSafe(F.col("first")), F.col("mask")).otherwise(F.lit(-1)).alias("mask"))
    out = marks.where("mask <> 0").groupBy(*row).agg(F.collect_list(F.struct("start", "n", "a", "mask")).alias("out"))
    return _removed(with_texts(out, "left"), window).withColumnsRenamed({"doc": row_id, "text": text})


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
