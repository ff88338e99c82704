"""Token-id files with Re-Pair grammar compression and random access.

Texts are encoded by a tokenizer of the ``tokenizers`` library; each document ends with the end id. Documents stand
in ascending order of their ids, in shards that are ranges of ids, in blocks of about ``BLOCK_TOKENS`` tokens.

File format: one Parquet table of blocks, written by Spark, so any store that Spark writes to can hold it and a lost
task leaves no partial file. A block holds ``shard``, ``block``, ``n_tokens``, the documents' ids (``doc_ids``) and
token counts (``counts``), and its grammar: ``rules`` (pairs of symbols; rule r defines symbol base + r), ``lengths``
(how many ids each rule expands to) and ``symbols`` (the compressed sequence). Rules and lengths are little-endian
unsigned integers of 32 bits; symbols are packed, ``width`` bits each, high bits first. A position is found by summing the symbols' expansion lengths, so a document, or any run of ids, is
decoded without expanding what lies before it.

Re-Pair replaces frequent pairs by new symbols, again and again, until none stands at ``least_count`` places that don't
overlap (a rule takes three numbers, so from four places on it saves room). A round here replaces many pairs at once: all
frequent ones that can't overlap, because no symbol is the left part of one and the right part of another. Pairs of equal symbols are replaced from left to right. Pairs are first
counted in hashed buckets, and exactly where a bucket is large.

Null and empty texts are documents of the end id alone; a very long text is a block of its own length. Null ids come first; rows with equal ids stand in an order
given by their texts. An empty table gives an empty file. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from tidemark.llm.shared import stored
from tidemark.llm.words import slices

BLOCK_TOKENS = 1_000_000
#: Places of a pair from which it is replaced.
LEAST_COUNT = 4
_BITS = 16
#: Texts encoded at once: their new words go to the library together.
AT_ONCE = 1024
#: Bytes of texts whose words are told apart at once.
BYTES_AT_ONCE = 1 << 22
#: Words whose ids a worker remembers, at about 180 bytes each.
MEMO = 1_200_000
# What the vocabulary's pre-tokenizer takes as one word, for lower-case texts up to U+00FF.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
#: Kinds of lower-case Latin-1 characters: blank, letter, digit, other.
_KIND = np.array([0 if c == 32 or 9 <= c <= 13 else 1 if 97 <= c <= 122 or c >= 0xDF and c != 0xF7 else 2 if 48 <= c <= 57 else 3 for c in range(256)], np.uint8)
#: Latin-1 characters that the fast path leaves to the library: ASCII separators, which count as white space here but
#: not there, and what isn't a letter above ASCII.
_ODD = bytes([*range(0x1C, 0x20), *range(0x80, 0xC0), 0xD7, 0xF7])
# What a vocabulary file says if its texts fall apart as ``_PIECES`` tells.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def splits_words(tokenizer_json: str) -> bool:
    """Whether a vocabulary's words can be cut by ``_PIECES``; else its texts go to the library whole."""
    found = json.loads(tokenizer_json)
    steps = (found.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (found.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == (_SPLIT, "Removed", True)
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        and found["model"].get("end_of_word_suffix") == "</w>"
        and all(t["content"].startswith("<|") for t in found.get("added_tokens") or [])
    )


def _latin(text: str) -> bytes | None:
    """The text's Latin-1 bytes if the fast path knows all of it: ASCII and Latin-1 letters, and nothing that opens a
    special token."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return raw if b"<|" not in raw and len(raw) == len(raw.translate(None, _ODD)) else None


def _is_plain(text: str) -> bool:
    return _latin(text) is not None


def _plain(text: str) -> bytes | None:
    """The text's lower-case Latin-1 bytes if the fast path knows all of it."""
    raw = _latin(text)
    return raw if raw is None else raw.translate(_LOWER)


def _cut(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of ``_PIECES`` in lower-case Latin-1 bytes that end with three blanks, and the places where they start: 's, 't, 're,
    've, 'm, 'll and 'd where a word starts, else runs of letters, single digits, and runs of other characters."""
    b = np.frombuffer(raw, np.uint8)
    kind = _KIND[b]
    inside = kind != 0
    start = inside.copy()
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    at = np.flatnonzero(start & (b == 39))
    one, two = b[at + 1], b[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (one == 108) & (two == 108) | ((one == 114) | (one == 118)) & (two == 101)
    for own, n in ((at[short], 2), (at[long], 3)):
        start[own + 1] = False
        start[own + n] |= kind[own + n] == 1
    data, places = b[inside], np.flatnonzero(start)
    ends = np.append(np.flatnonzero(start[inside]), len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(data)]), places


class WordTokenizer:
    """Encodes texts with a tokenizer whose pre-tokenizer splits them into words; ``memo`` maps words to ids as bytes.

    In texts of ASCII and Latin-1 letters the words are cut here, for many texts at once, and only the distinct ones of
    them are looked up; each goes to the library once. All
    other texts go to the library whole. Both give what the library gives for the whole text. New words go to the
    library in one text, parted by blanks; ids that end a word tell them apart again. For them the library parts at blanks
    only: words that were cut here are in the normal form already, and fall apart no further.
    """

    def __init__(self, tokenizer_json: str, split_words: bool | None = None):
        self.json = tokenizer_json
        self.split_words = splits_words(tokenizer_json) if split_words is None else split_words
        self.memo: dict[bytes, bytes] = {}
        vocabulary = self.words.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_str(self.json)

    @cached_property
    def words(self) -> Tokenizer:
        if not self.split_words:
            return self.tokenizer
        found = json.loads(self.json)
        found["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        return Tokenizer.from_str(json.dumps(found | {"normalizer": None, "added_tokens": []}))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def learn(self, words: list[bytes]) -> None:
        ids = np.array(self.words.encode_batch_fast([b" ".join(words).decode("latin-1")], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends_word[ids]) + 1
        if len(cuts) == len(words) and cuts[-1] == len(ids):
            raw, ends = ids.tobytes(), (4 * cuts).tolist()
            self.memo.update(zip(words, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        else:  # a word whose ids end no word, or several: one by one
            each = self.words.encode_batch_fast([w.decode("latin-1") for w in words], add_special_tokens=False)
            self.memo.update(zip(words, (np.array(e.ids, "<u4").tobytes() for e in each), strict=True))

    def _by_words(self, raws: list[bytes]) -> list[bytes]:
        """The ids of texts that ``_plain`` gave."""
        words, places = _cut(b"\n".join([*raws, b"\n\n\n"]))
        coded = words.dictionary_encode()
        distinct, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [w for w in distinct if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = distinct
        if new:
            self.learn(new)
        each = [self.memo[w] for w in distinct]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        n, first = size[number], (np.cumsum(size) - size)[number]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(first - ends[:-1], n)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(each), "<u4")[at].tobytes()
        starts = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
        cuts = (4 * ends[np.searchsorted(places, starts)]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raws = [_plain(t) if t and self.split_words else None for t in texts]
        coded, held, size = [], [], 0
        for raw in filter(None, raws):
            held.append(raw)
            size += len(raw)
            if size >= BYTES_AT_ONCE:
                coded += self._by_words(held)
                held, size = [], 0
        if held:
            coded += self._by_words(held)
        own, whole = iter(coded), iter(self._whole([t for t, r in zip(texts, raws, strict=True) if t and r is None]))
        return [b"" if not t else np.array(next(whole), "<u4").tobytes() if r is None else next(own) for t, r in zip(texts, raws, strict=True)]


_TOKENIZERS: dict[int, WordTokenizer] = {}


def _tokenizer(shared) -> WordTokenizer:
    text = shared.value
    key = xxhash.xxh64_intdigest(text)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(text)
    return _TOKENIZERS[key]


def _choose(left: np.ndarray, right: np.ndarray, count: np.ndarray, symbols: int) -> list[int]:
    """Indices of pairs of which none can overlap another, the most frequent first. The first always is among them."""
    is_left, is_right = bytearray(symbols), bytearray(symbols)
    chosen = []
    order = np.argsort(-count, kind="stable")
    for i, a, b in zip(order.tolist(), left[order].tolist(), right[order].tolist(), strict=True):
        if not is_right[a] and not is_left[b]:
            is_left[a] = is_right[b] = 1
            chosen.append(i)
    return chosen


def _numbered(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (left, right) that stand at ``least`` places or more, and each place's number among them, or -1."""
    bucket = a * np.uint32(0x9E3779B1)
    bucket += b
    bucket *= np.uint32(0x85EBCA77)
    bucket >>= np.uint32(32 - _BITS)
    # Only what a large bucket holds can be frequent; that is then counted exactly.
    often = np.flatnonzero((np.bincount(bucket, minlength=1 << _BITS) >= least)[bucket])
    number = np.full(len(a), -1, np.int32)
    if not len(often):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), number
    left, right = a[often], b[often]
    wide, far = int(right.max()).bit_length(), len(a).bit_length()
    if int(left.max()).bit_length() + wide + far <= 64:
        # Pair and place in one number, which sorts faster than places by their pairs.
        code = ((left.astype(np.uint64) << np.uint64(wide) | right) << np.uint64(far)) | often.astype(np.uint64)
        code.sort()
        place = (code & np.uint64((1 << far) - 1)).astype(np.int64)
        code >>= np.uint64(far)
    else:
        code, wide = left.astype(np.uint64) << np.uint64(32) | right, 32
        order = np.argsort(code)
        place, code = often[order], code[order]
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    count = np.diff(start, append=len(code))
    enough = count >= least
    number[place] = np.repeat(np.where(enough, np.cumsum(enough) - 1, -1), count)
    code = code[start[enough]]
    return (code >> np.uint64(wide)).astype(np.int64), (code & np.uint64((1 << wide) - 1)).astype(np.int64), number


def compress(ids: np.ndarray, base: int, least_count: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rules (k x 2), lengths (k), symbols. base is above every id; least_count is 2 or more.

    The sequence is a linked list, so that a round costs what its frequent pairs and its changes do. A pair of old
    symbols never becomes more frequent, and all places of a pair with a new symbol are made in one round; so places
    of pairs that are rare once aren't looked at again.
    """
    n = len(ids)
    seq, rules, lengths = ids.astype(np.uint32), [], [np.ones(base, np.uint32)]
    total = base
    if n >= 2 * least_count:
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        here = np.ones(n, bool)
        left, right, pair = _numbered(seq[:-1], seq[1:], least_count)
        pair = np.append(pair, np.int32(-1))
        while len(left):
            at = np.flatnonzero(pair >= 0)
            own = pair[at]
            equal = np.flatnonzero((left == right)[own]) if (left == right).any() else at[:0]
            if len(equal):
                # In a run of one symbol every second place counts, from its start.
                p = at[equal]
                start = np.concatenate(([True], (after[p[:-1]] != p[1:])))
                place = np.arange(len(p))
                odd = (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 1
                counted = np.ones(len(at), bool)
                counted[equal[odd]] = False
                count = np.bincount(own[counted], minlength=len(left))
            else:
                count = np.bincount(own, minlength=len(left))
            enough = np.flatnonzero(count >= least_count)
            if not len(enough):
                break
            chosen = np.sort(enough[_choose(left[enough], right[enough], count[enough], total)])
            rule = np.full(len(left), -1, np.int32)
            rule[chosen] = np.arange(len(chosen), dtype=np.int32)
            hit = rule[own] >= 0
            if len(equal):
                hit &= counted
            first = at[hit]
            gone = after[first]
            seq[first] = (total + rule[own[hit]]).astype(np.uint32)
            after[first] = after[gone]
            before[after[first]] = first
            here[gone] = False
            new = np.stack((left[chosen], right[chosen]), 1).astype(np.uint32)
            so_far = np.concatenate(lengths)
            lengths.append(so_far[new[:, 0]] + so_far[new[:, 1]])
            rules.append(new)
            total += len(new)
            # Rare pairs go, and the places next to a change get the numbers of their new pairs.
            kept = count >= least_count
            kept[chosen] = False
            number = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)
            pair[at] = number[own]
            pair[gone] = -1
            changed = np.zeros(n + 1, bool)
            changed[first] = changed[before[first]] = True  # before the first place stands -1, the last of n + 1
            changed = np.flatnonzero(changed[:n])
            pair[changed] = -1
            changed = changed[after[changed] < n]
            left, right = left[kept], right[kept]
            l, r, found = _numbered(seq[changed], seq[after[changed]], least_count)
            pair[changed] = np.where(found >= 0, found + len(left), -1)
            left, right = np.concatenate((left, l)), np.concatenate((right, r))
        seq = seq[here]
    if not rules:
        return np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32), seq
    return np.concatenate(rules), np.concatenate(lengths[1:]), seq


def packed(x: np.ndarray, width: int) -> bytes:
    """Numbers below 2^width, of at most 32 bits, in width bits each."""
    bits = np.unpackbits(x.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :]).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    n = 8 * len(raw) // width if width >= 8 else 0
    bits = np.zeros((n, 32), np.uint8)
    bits[:, 32 - width :] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u4").ravel().astype(np.int32)


class Grammar:
    """Expands a block's symbols, whole or in part."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, base: int):
        self.base, self.symbols = base, symbols
        rules = rules.reshape(-1, 2).astype(np.int64)
        self.length = np.concatenate((np.ones(base, np.int32), lengths.astype(np.int32)))
        self.offset = np.concatenate((np.arange(base), base + np.cumsum(lengths, dtype=np.int64) - lengths)).astype(np.int32)
        self.flat = np.empty(base + int(lengths.sum(dtype=np.int64)), np.uint32)
        self.flat[:base] = np.arange(base, dtype=np.uint32)
        self._ends = None
        # As many rules at once as are made of symbols before them.
        newest = np.maximum.accumulate(rules.max(1)) - base if len(rules) else rules[:, 0]
        start = 0
        while start < len(rules):
            stop = int(np.searchsorted(newest, start))
            own = self._expand(rules[start:stop].ravel())
            self.flat[self.offset[base + start] :][: len(own)] = own
            start = stop

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        ends = np.cumsum(n, dtype=np.int32)  # a block's ids and expansions are far below 2^31
        at = np.repeat(self.offset[symbols] - (ends - n), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at]

    def all(self) -> np.ndarray:
        return self._expand(self.symbols)

    def part(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], expanding only the symbols that overlap them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        if self._ends is None:
            self._ends = np.cumsum(self.length[self.symbols], dtype=np.int64)
        ends = self._ends
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(self.symbols[a:b])[start - before : stop - before]


_BLOCK = "shard int, block int, n_tokens bigint, base int, doc_ids array<{id}>, counts array<bigint>, rules binary, lengths binary, width int, symbols binary"


def write(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, text: str = "text", row_id: str = "doc_id", least_count: int = LEAST_COUNT
) -> None:
    """Writes the file. Ids may be of any type that has an order."""
    if least_count < 2:
        raise ValueError("a pair is replaced from two places on")
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    # A vocabulary file, of a few MB whatever the table's size.
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    base = max(Tokenizer.from_str(vocabulary).get_vocab_size(), end_id + 1)
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def block(shard, number, ids, coded, id_type):
        rules, lengths, symbols = compress(np.frombuffer(b"".join(coded), "<u4"), base, least_count)
        width = max(8, (base + len(rules) - 1).bit_length())
        values = {
            "shard": (pa.int32(), shard), "block": (pa.int32(), number), "n_tokens": (pa.int64(), sum(map(len, coded)) // 4), "base": (pa.int32(), base),
            "doc_ids": (pa.list_(id_type), ids), "counts": (pa.list_(pa.int64()), [len(c) // 4 for c in coded]),
            "rules": (pa.binary(), rules.astype("<u4").tobytes()), "lengths": (pa.binary(), lengths.astype("<u4").tobytes()),
            "width": (pa.int32(), width), "symbols": (pa.binary(), packed(symbols, width)),
        }
        return pa.RecordBatch.from_pydict({c: pa.array([v], t) for c, (t, v) in values.items()})

    def run(batches):
        own, shard, number = _tokenizer(shared), TaskContext.get().partitionId(), 0
        ids, coded, size, id_type = [], [], 0, None
        for part in slices(batches, AT_ONCE):
            id_type = part.column("id").type
            for i, c in zip(part.column("id").to_pylist(), own.encode(part.column("text").to_pylist()), strict=True):
                ids.append(i)
                coded.append(c + end)
                size += len(c) // 4 + 1
                if size >= BLOCK_TOKENS:
                    yield block(shard, number, ids, coded, id_type)
                    ids, coded, size, number = [], [], 0, number + 1
        if ids:
            yield block(shard, number, ids, coded, id_type)

    rows.mapInArrow(run, _BLOCK.format(id=kind)).write.parquet(path)


def _grammar(row) -> Grammar:
    rules, lengths = (np.frombuffer(row[c], "<u4") for c in ("rules", "lengths"))
    return Grammar(rules, lengths, unpacked(row["symbols"], row["width"]), row["base"])


def _starts(blocks: DataFrame) -> DataFrame:
    """The ids before each block: those of earlier shards, plus those of earlier blocks of its shard."""
    own = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("inside"))
    # One row a shard, that is a partition of the writing job.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return inside.join(shards, "shard").select("shard", "block", (F.col("inside") + F.col("before")).alias("block_start"))


def read(spark: SparkSession, path: str, row_id: str = "doc_id") -> DataFrame:
    """row_id, start, n_tokens and ids (little-endian unsigned 32-bit integers) of every document of a file."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # A row a block, stored on its own, so that Spark sees how small it is before it decides to move the blocks.
    starts = stored(_starts(blocks.select("shard", "block", "n_tokens")), "block-starts")
    placed = blocks.join(starts, ["shard", "block"])

    def run(batches):
        for part in slices(batches, 1):
            row = {c: part.column(c)[0].as_py() for c in part.schema.names}
            ids = pa.py_buffer(_grammar(row).all().astype("<u4", copy=False))
            counts = np.asarray(row["counts"], np.int64)
            ends = np.concatenate(([0], np.cumsum(counts)))
            # The documents' ids are slices of one buffer.
            own = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((4 * ends).astype(np.int32)), ids])
            whole = pa.RecordBatch.from_pydict(
                {row_id: part.column("doc_ids").values.slice(part.column("doc_ids").offsets[0].as_py(), len(counts)), "start": pa.array(ends[:-1] + row["block_start"]), "n_tokens": pa.array(counts), "ids": own}
            )
            yield from slices([whole], 4096)

    return placed.mapInArrow(run, f"{row_id} {kind}, start bigint, n_tokens bigint, ids binary")


def read_part(spark: SparkSession, path: str, shard: int, block: int, start: int, stop: int) -> np.ndarray:
    """ids[start:stop] of one block: reads that row and expands only what overlaps."""
    row = spark.read.parquet(path).where((F.col("shard") == shard) & (F.col("block") == block)).first()
    return _grammar(row).part(start, stop)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
