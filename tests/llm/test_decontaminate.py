from __future__ import annotations

import random

import pytest

from tidemark.llm import decontaminate as D
from tidemark.llm.suffix_automaton import SuffixAutomaton
from tidemark.llm.words import plain_words


def brute(text, items, window):
    words, hit, found = plain_words(text), set(), set()
    for item, body in items:
        own = plain_words(body)
        n = min(window, len(own))
        for s in range(len(own) - n + 1) if own else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[s : s + n]:
                    hit |= set(range(at, at + n))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def random_case(seed, window):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, window - 1, window, 2 * window))))) for k in range(5)]
    items += [("empty", ""), ("null", None)]
    texts = [" ".join(rng.choice(vocabulary + ["z", "y"]) for _ in range(rng.randrange(60))) for _ in range(6)]
    texts += [f"Before {items[3][1].upper()}, after! {items[4][1]}", "", None]
    return items, texts


@pytest.mark.parametrize("seed", range(30))
def test_matcher_equals_brute_force(seed):
    items, texts = random_case(seed, 4)
    matcher = D.ItemMatcher(items, 4)
    for text in texts:
        words = plain_words(text)
        spans, found, _ = matcher.match(words)
        assert (len(words), sum(b - a for a, b in spans), sorted(found)) == brute(text, items, 4)


def test_longer_windows_only():
    items = [("a", " ".join(f"w{i}" for i in range(30)))]
    matcher = D.ItemMatcher(items, 10)
    text = "x " + " ".join(f"w{i}" for i in range(5, 17)) + " y w1 w2"
    spans, found, longest = matcher.match(plain_words(text))
    assert (spans, found, longest) == ([(1, 13)], {"a"}, 12)


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(12)) for _ in range(4)]
    sam = SuffixAutomaton()
    for w in words:
        sam.add(w)
    subs = {w[i:j] for w in words for i in range(12) for j in range(i + 1, 13)}
    for w in ("".join(rng.choice("ab") for _ in range(9)) for _ in range(60)):
        v = n = 0
        for i, x in enumerate(w, 1):
            v, n = sam.step(v, n, x)
            assert n == max((k for k in range(i + 1) if w[i - k : i] in subs or k == 0))


def test_without_removes_words_and_keeps_the_rest():
    assert D.without("One, two (three) four. Ünf six", [(1, 3), (4, 5)]) == "One, ) four.  six"


def test_one_pass_and_shards_give_the_same(spark):
    items, texts = random_case(77, 4)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    one = D.decontaminate(docs, bench, window=4)
    many = D.decontaminate(docs, bench, window=4, max_words=20)
    key = lambda df: sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["clean_text"]) for r in df.collect())
    assert key(one) == key(many)
    for r in one.collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], items, 4)


def test_repeated_words_take_linear_time_and_very_long_texts_are_matched_whole():
    import time

    items = [("a", "la " * 40), ("b", "la " * 3), ("c", "do re " * 8)]
    matcher = D.ItemMatcher(items, 10)
    start = time.perf_counter()
    spans, found, longest = matcher.match(plain_words("la " * 8000))
    assert time.perf_counter() - start < 0.1
    assert (spans, found, longest) == ([(0, 8000)], {"a", "b"}, 40)
    spans, found, _ = matcher.match(plain_words("x y z " * 100_000 + "do re " * 5 + "end"))
    assert (spans, found) == ([(300_000, 300_010)], {"c"})
    start = time.perf_counter()
    D.ItemMatcher([("long", "la " * 20_000)], 10)
    assert time.perf_counter() - start < 2


def test_shards_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "x b c d y e f g", "p", "q", 3)], "doc_id long, text string, p_items string, spans string, words int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["b c d", "e f g", "c d y", "never seen"])], "item_id long, text string")
    one, many = D.decontaminate(docs, bench), D.decontaminate(docs, bench, max_words=3)
    assert one.columns == many.columns and one.first() == many.first()
    assert one.first()["hit_spans"] == [[1, 8]] and one.first()["p_items"] == "p"


def test_no_items_no_documents_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, None), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in D.digests(D.decontaminate(docs, nothing)).collect()] == [False] * 3
    bench = spark.createDataFrame([(5, "B c"), (5, "b C"), (6, None)], "item_id long, text string")
    out = D.digests(D.decontaminate(docs, bench)).collect()
    assert sorted((r["n_hit"], r["n_items"]) for r in out) == [(0, 0), (2, 1), (2, 1)]
    assert D.decontaminate(docs.limit(0), bench).count() == 0


def test_clean_removes_spans_and_drops_what_is_mostly_benchmark(spark):
    docs = spark.createDataFrame([(1, "keep this b c too please", "x"), (2, "b c", "y"), (3, None, "z")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    out = D.clean(docs.withColumnRenamed("items", "other"), bench)
    assert sorted(map(tuple, out.collect())) == [(1, "keep this  too please", "x"), (3, None, "z")]
