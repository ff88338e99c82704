from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", "a", " ", "\n\n  x ", "it's I'LL don't", "日本語テキスト 123 ½ ﷽", "x" * 3000, "á é \u0085 ", "ab" * 2000 + " " * 500, "🙂🙃 ok’s",
]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_ids_equal_the_library_and_round_trip(coder, library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab \n'sé½²\xa0!日") for _ in range(200)) for _ in range(100)]
    texts += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(300)) for _ in range(20)]
    for text in texts:
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_the_queue_is_empty_after_each_pre_token(coder):
    coder.merge("unbelievably longwordwithoutspaces".encode() * 3)
    assert not coder.buckets and not any(coder.low) and not any(coder.mid)


def test_a_very_long_pre_token_takes_about_linear_time(coder):
    from time import process_time

    def seconds(n):
        t = process_time()
        coder.merge(b"abcdefghij" * n)
        return process_time() - t

    seconds(100)
    assert seconds(20_000) < 60 * max(seconds(1_000), 0.005)


def test_rows_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, "old"), (2, "", "old"), (3, "hello hello", "old"), (3, "hello hello", "old"), (None, "x" * 200_000, "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_le string")
    out = byte_bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == 5
    for r in out:
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert len(r["ids_le"]) % 4 == 0
    back = byte_bpe.decode(byte_bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert byte_bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    digest = byte_bpe.digests(byte_bpe.round_trip(df, PATH, public_tokenizers.PATTERN))
    assert {r["n_tokens"] for r in digest.where("doc_id = 1").collect()} == {0}
