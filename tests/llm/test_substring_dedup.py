from __future__ import annotations

import random

import pytest

from tidemark.llm import substring_dedup as D


def brute(rows, window):
    """rows in order of id: (n_words, n_removed, kept)."""
    seen, out = set(), []
    for _, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        out.append((len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(40)}" for _ in range(rng.randrange(4, 50))] for _ in range(8)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += rng.choice(passages)[rng.randrange(5) :] if rng.random() < 0.7 else [f"u{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        out.append((i, " ".join(words)))
    out += [(n, out[3][1]), (n + 1, "la " * 200), (n + 2, None), (n + 3, "la " * 40 + "end"), (n + 4, ""), (n + 5, "ab cd ef " * 30)]
    return out


@pytest.mark.parametrize(("seed", "window", "hot"), [(1, 6, 1000), (2, 6, 2), (3, 20, 1000), (4, 2, 1000), (5, 7, 1)])
def test_equals_brute_force(spark, seed, window, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = D.dedup_substrings(docs, window=window, hot=hot).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in out] == brute(rows, window)


def test_repeated_windows_streams_pieces_in_order():
    a, b = [b"a", b"b", b"c", b"d"], [b"x", b"b", b"c", b"d"]
    assert D.repeated_windows([a, b, a], 3) == [0, 2, 3]


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, 1), (5, text, 1), (None, text, 1), (9, text + " more", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchor int")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in D.dedup_substrings(docs).collect())
    assert got == [(-1, 0), (5, 30), (5, 30), (9, 30)]
    one = spark.createDataFrame(rows[:2], "doc_id long, text string, anchor int")
    assert [r["n_removed"] for r in D.dedup_substrings(one).collect()] == [0, 0]
    assert D.dedup_substrings(docs.limit(0)).count() == 0


def test_no_shard_grows_with_the_different_pieces_of_a_template(spark, monkeypatch):
    words = [f"t{i}" for i in range(24)]
    rows = [(i, " ".join([f"u{i}", *words[:12], f"slot{i}", *words[12:], f"v{i}"])) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    largest, judged = [], D._judged

    def watched(fetched, window):
        by = "route" if "route" in fetched.columns else "anchor"
        largest.append(max((r["count"] for r in fetched.groupBy(by).count().collect()), default=0))
        return judged(fetched, window)

    monkeypatch.setattr(D, "_judged", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = D.dedup_substrings(docs, window=8, hot=10).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in out] == brute(rows, 8)
    assert largest[0] <= 10


def test_common_passages_null_ids_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "COMMON", 3)
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(40))
    long = [f"l{rng.randrange(5000)}" for _ in range(80_000)]
    rows = [(i, f"a{i} b{i} {shared} c{i}") for i in range(80)] + [(100, " ".join(long)), (101, " ".join(long[40_000:]) + " end"), (102, " ".join(long[:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = D.dedup_substrings(docs, window=8).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in out] == brute(rows, 8)
    # Rows without an id are one document, the first: they lose nothing to one another, and others lose to them.
    none = [(None, f"n{i} {shared}") for i in range(30)] + [(None, None), (None, "")]
    out = D.dedup_substrings(spark.createDataFrame(none + rows[:5], "doc_id long, text string").repartition(5), window=8).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in out if r["doc_id"] is None or r["doc_id"] > 0) == [(-1, 0)] * 32 + [(i, 40) for i in range(1, 5)]
