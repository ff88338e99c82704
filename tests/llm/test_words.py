from __future__ import annotations

import random

import numpy as np

from tidemark.llm import words as W


def test_hashes_follow_the_words(monkeypatch):
    rng = random.Random(6)
    raws = [b"", b"  ", b"a", b" a\tb\n\x0b\x0c\r c ", "ü ünf \x85 x".encode()] + [bytes(rng.choice(b"ab \n\xc3\xa9") for _ in range(400)) for _ in range(30)]
    seen = {}
    for part in (1 << 20, 16):
        monkeypatch.setattr(W, "PART", part)
        for raw in raws:
            hashes = W.word_hashes(raw).tolist()
            assert len(hashes) == len(raw.split())
            for word, h in zip(raw.split(), hashes, strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_run_hashes_depend_on_the_run_alone():
    hash_runs = W.RunHash(0x9E3779B97F4A7C15)
    x = np.array([5, 6, 7, 5, 6, 7, 5], np.uint64)
    a, b, c = hash_runs(x, np.array([0, 3, 0]), np.array([3, 6, 2])).tolist()
    assert a == b != c


def test_window_hashes_of_short_and_equal_runs():
    x = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    h = W.window_hashes(x, 3)
    assert len(h) == 4 and h[0] == h[3] and len(set(h.tolist())) == 3
    assert len(W.window_hashes(x, 9)) == 0
