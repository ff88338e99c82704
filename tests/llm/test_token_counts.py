from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\n x ", "it's I'LL don't 's", "日本語テキスト 123 ½ ﷽", "x" * 3000, "á é \u0085 é", "ab" * 2000 + " " * 500, "🙂🙃 ok’s", "ΣΑΣ ΟΔΟΣ İi",
    "<|endoftext|>", "a<|endoftext|>b<|startoftext|><|endoftext|> c", "<|END|>", "<|endoftext", "a\x1cb\x1fc d　e", "\x00\x01", "ﬁne Ǆ ß ẞ", "a" * 5000 + "é" * 5000,
]


def _json():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(_json())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(counter, library):
    rng = random.Random(13)
    texts = ODD + ["".join(rng.choice("ab \n'sé½²\xa0!日TH<|>") for _ in range(200)) for _ in range(100)]
    texts += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(300)) for _ in range(20)]
    for text in texts:
        assert counter.count(text) == _expected(library, text), text[:50]


def test_popping_the_least_rank_equals_scanning_for_it(counter):
    """A plain merge that looks at all pairs each time, leftmost first, does as many merges."""
    rng = random.Random(3)
    for _ in range(300):
        word = bytes(rng.choice(b"aeinorst") for _ in range(rng.randint(1, 40)))
        symbols, merges = [*(counter.inner[b] for b in word[:-1]), counter.final[word[-1]]], 0
        while found := [(r, i) for i in range(len(symbols) - 1) if (r := counter.rank.get(symbols[i] << 20 | symbols[i + 1])) is not None]:
            rank, i = min(found)
            symbols[i : i + 2] = [counter.made[rank]]
            merges += 1
        assert counter.merged(word) == len(word) - merges == len(symbols)


def test_a_very_long_word_takes_about_linear_time(counter):
    from time import process_time

    def seconds(n):
        t = process_time()
        counter.merged(b"abcdefghij" * n)
        return process_time() - t

    seconds(100)
    assert seconds(20_000) < 60 * max(seconds(1_000), 0.005)


def test_the_memo_is_bounded(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    counter.clear()
    text = "one two three four five six " + "long" * 100
    assert counter.count(text) == _expected(library, text)
    assert len(counter) <= 3


def test_vocabularies_of_other_kinds_are_refused():
    for change in ({"dropout": 0.1}, {"type": "WordPiece"}, {"ignore_merges": True}):
        found = json.loads(_json())
        found["model"] |= change
        with pytest.raises(ValueError):
            token_counts.TokenCounter(json.dumps(found))


def test_rows_nulls_repeats_clashing_columns_and_empty_tables(spark, library):
    rows = [(1, None, "old"), (2, "", "old"), (3, "hello hello", "old"), (3, "hello hello", "old"), (None, "word " * 50_000, "old"), (4, "x" * 200_000, "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = token_counts.count_tokens(df, PATH)
    assert out.columns == ["doc_id", "text", "n_tokens"]
    found = out.collect()
    assert len(found) == 6 and all(r["n_tokens"] == _expected(library, r["text"]) for r in found)
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0
    sizes = {(r["doc_id"], r["n_bytes"], r["over_limit"]) for r in token_counts.sizes(out, 2048).collect()}
    assert sizes == {(1, 0, False), (2, 0, False), (3, 11, False), (None, 250_000, True), (4, 200_000, _expected(library, "x" * 200_000) > 2048)}


def test_the_query_equals_the_library_on_a_whole_table(spark, library):
    from tidemark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op13_token_counts"](spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        n = _expected(library, texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 2048)
