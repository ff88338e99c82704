from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_grammar_is_an_exact_round_trip_with_random_access(seed):
    rng = np.random.default_rng(seed)
    motifs = [rng.integers(0, 500, rng.integers(2, 30)) for _ in range(12)]
    ids = np.concatenate([motifs[i] for i in rng.integers(0, 12, 900)] + [rng.integers(0, 500, 50)]).astype(np.uint32)
    rules, lengths, symbols = T.compress(ids, 500)
    g = T.Grammar(rules, lengths, symbols, 500)
    assert (g.all() == ids).all()
    assert len(symbols) < 0.6 * len(ids)
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (g.part(a, b) == ids[a:b]).all()
    for own in ([], [7], [1, 1, 1, 1] * 300):
        own = np.array(own, np.uint32)
        assert (T.Grammar(*T.compress(own, 500), 500).all() == own).all()


def most_frequent(symbols):
    """Places of the most frequent pair, left to right without overlap."""
    count, last = {}, {}
    for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist(), strict=False)):
        if last.get(pair) != i - 1 or pair[0] != pair[1]:
            count[pair], last[pair] = count.get(pair, 0) + 1, i
    return max(count.values(), default=0)


def test_no_frequent_pair_is_left_however_deep_the_repetition():
    rng = np.random.default_rng(7)
    passage = rng.integers(0, 500, 300)
    noise = [rng.integers(0, 500, 5) for _ in range(90)]
    copied = np.concatenate([x for own in noise for x in (own, passage)])
    words = rng.zipf(1.3, 60_000) % 500
    runs = np.repeat(rng.integers(0, 3, 2000), rng.integers(1, 40, 2000))
    for ids in (copied, words, runs, np.full(100_000, 9), np.full(127, 9), np.full(128, 9), np.full(129, 9)):
        ids = ids.astype(np.uint32)
        rules, lengths, symbols = T.compress(ids, 500)
        g = T.Grammar(rules, lengths, symbols, 500)
        assert (g.all() == ids).all()
        assert (g.part(len(ids) // 3, len(ids) // 2) == ids[len(ids) // 3 : len(ids) // 2]).all()
        assert most_frequent(symbols) < T.LEAST_COUNT
        for least in (2, 64):
            rules, lengths, symbols = T.compress(ids, 500, least)
            assert (T.Grammar(rules, lengths, symbols, 500).all() == ids).all() and most_frequent(symbols) < least
    assert len(T.compress(copied.astype(np.uint32), 500)[2]) < 7 * len(noise)
    # The most doubled symbol, and at most one symbol of each lesser length.
    assert len(T.compress(np.full(100_000, 9, np.uint32), 500)[2]) < 2 * T.LEAST_COUNT + 17


@pytest.mark.parametrize("width", [8, 9, 16, 17, 31])
def test_packed_numbers_come_back(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    assert len(T.packed(x, width)) == -(-1001 * width // 8)
    assert (T.unpacked(T.packed(x, width), width) == x).all()
    assert len(T.unpacked(T.packed(x[:0], width), width)) == 0


def test_new_words_are_not_cut_a_second_time(monkeypatch):
    """Words that were cut here meet no normalizer and no pattern of the library again; other texts do."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    own, whole = T.WordTokenizer(vocabulary), T.WordTokenizer(vocabulary, split_words=False)
    texts = ["Don't stop -- it's 1990's \"caf\xe9\" na\xefve\tSTRA\xdfE", "--'s 'll''t a1b2 <| x", "\u4e2d\u6587 and K\u0301", "", None]
    assert own.encode(texts[:1]) == whole.encode(texts[:1])
    assert "tokenizer" not in vars(own) and own.words.normalizer is None
    assert own.encode(texts) == whole.encode(texts) and "tokenizer" in vars(own)


def test_words_are_cut_for_many_texts_at_once_as_the_pattern_cuts_each(monkeypatch):
    pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
    rng = random.Random(3)
    texts = ["'", "'l", "'ll", "'re've", "''s", "-'s", "'stop", "1's", "'s't'", "  ", "'\n's", "a'", "'v", "'ve"]
    texts += ["".join(rng.choice("''stmdrevlla1 É.\n\x00") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    raws = [T._plain(t) for t in texts]
    assert [r.decode("latin-1") for r in raws] == [t.lower() for t in texts]
    words, places = T._cut(b"\n".join([*raws, b"\n\n\n"]))
    assert [w.decode("latin-1") for w in words.to_pylist()] == [w for t in texts for w in pieces.findall(t.lower())] and len(places) == len(words)
    with open(PATH, encoding="utf-8") as f:
        vocabulary = f.read()
    asked, whole = [], T.WordTokenizer(vocabulary, split_words=False).encode(texts)
    monkeypatch.setattr(T, "MEMO", 40)
    for size in (1, 1 << 22):
        monkeypatch.setattr(T, "BYTES_AT_ONCE", size)
        own = T.WordTokenizer(vocabulary)
        by_words = own._by_words
        monkeypatch.setattr(own, "_by_words", lambda raws, f=by_words: asked.append(len(raws)) or f(raws))
        assert own.encode(texts) == whole
    assert asked == [1] * len(texts) + [len(texts)]


def test_places_of_pairs_are_the_same_for_large_symbols():
    """Pairs that don't fit one number together with their places are numbered as small ones are."""
    rng = np.random.default_rng(5)
    small = rng.integers(0, 12, 5000).astype(np.uint32)
    names = np.sort(rng.choice(2**31, 12, replace=False)).astype(np.uint32) + np.uint32(2**31)
    for least in (2, 4, 40):
        l, r, n = T._numbered(small[:-1], small[1:], least)
        large_l, large_r, m = T._numbered(names[small[:-1]], names[small[1:]], least)
        pairs, counts = np.unique(np.stack((small[:-1], small[1:])), axis=1, return_counts=True)
        assert np.array_equal(np.stack((l, r)), pairs[:, counts >= least]) and np.array_equal(n, m)
        assert np.array_equal(names[l], large_l) and np.array_equal(names[r], large_r)
        assert np.array_equal(l[n[n >= 0]], small[:-1][n >= 0]) and np.array_equal(r[n[n >= 0]], small[1:][n >= 0])
    none = T._numbered(small[:0], small[:0], 2)
    assert [len(x) for x in none] == [0, 0, 0]


def test_words_and_whole_texts_give_the_same_ids():
    with open(PATH, encoding="utf-8") as f:
        vocabulary = f.read()
    rng = random.Random(8)
    texts = ["ÀÉ İI ß ẞ", "it's I'LL 'S", "<|endoftext|> a", "a\x1cb", "x²½ª", "ﬁ é", "日本 語", "\x85\xa0a", "a'RE b", None, ""]
    texts += ["".join(rng.choice("ab 'sÉé<|>\n\t\x0b0٣²\x1d!") for _ in range(120)) for _ in range(150)]
    fast, slow = T.WordTokenizer(vocabulary), T.WordTokenizer(vocabulary, split_words=False)
    library = Tokenizer.from_str(vocabulary)
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert fast.encode(texts) == want
    assert slow.encode(texts) == want
    # Another vocabulary's words are not cut here.
    assert fast.split_words and not T.WordTokenizer(vocabulary.replace('"Lowercase"', '"NFC"')).split_words


def test_files_hold_documents_in_order_with_starts(spark, tmp_path, monkeypatch):
    rows = [(i, f"text number {i} " * (i % 7), "x") for i in range(300)] + [(500, None, "x"), (501, "", "x"), (7, "again", "x"), (None, "first", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    path = f"file://{tmp_path}/tokens"
    T.write(docs, path, PATH, end_id=1)
    out = T.read(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    at = 0
    for r, (doc_id, text, _) in zip(out, sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, at, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    block = spark.read.parquet(path).orderBy("shard", "block").first()
    want = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in out])[:30]
    assert T.read_part(spark, path, block["shard"], block["block"], 3, 20).tolist() == want[3:20].tolist()


@pytest.mark.parametrize("kind", ["string", "int", "date", "decimal(12,2)"])
def test_ids_of_other_types_and_very_long_texts(spark, tmp_path, kind):
    from pyspark.sql import functions as F

    docs = spark.range(6).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), "id")
    docs = docs.select((F.col("d") if kind == "date" else F.col("id").cast(kind)).alias("doc_id"), F.repeat(F.lit("long words "), F.when(F.col("id") == 3, 300_000).otherwise(2)).alias("text"))
    path = f"file://{tmp_path}/tokens"
    T.write(docs, path, PATH, end_id=1)
    out = T.read(spark, path)
    assert out.schema["doc_id"].dataType.simpleString() == kind
    got = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
    assert got == {r["doc_id"]: 600_001 if r["n"] > 100 else 5 for r in docs.select("doc_id", F.length("text").alias("n")).collect()}


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    T.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, end_id=1)
    assert T.read(spark, path).count() == 0
