from __future__ import annotations

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tidemark.llm import quality as Q


def good(seed, lines=6):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"word{rng.randrange(400)}" for _ in range(14)) + ", and so on." for _ in range(lines))


def poor(seed):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"tok{rng.randrange(900)}$$$ ###" for _ in range(9)) for _ in range(8))


def repeated_words(words):
    n = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({k for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)})


@pytest.mark.parametrize("seed", range(10))
def test_repeated_window_words(seed):
    rng = random.Random(seed)
    words = [rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(rng.randrange(40))]
    assert Q.repeated_window_words(words) == repeated_words(words)


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(1)
    field = Q.LineField(rng.normal(size=(Q.FEATURES, 2)), rng.normal(size=(2, 2)))
    for _ in range(20):
        chain = [sorted(rng.choice(Q.FEATURES, 3, replace=False).tolist()) for _ in range(6)]

        def score(labels, chain=chain):
            s = sum(field.emit[f, y] for own, y in zip(chain, labels, strict=True) for f in own)
            return s + sum(field.move[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(product((0, 1), repeat=6), key=score)
        assert tuple(field.decode(chain)) == best
    assert field.decode([]) == []


def test_training_raises_the_likelihood_of_its_labels():
    chains = [Q.chain(*Q.text_lines(t)) for t in (good(1), poor(1), good(2), poor(2))]
    labels = [[int(i % 2 == 0)] * len(c) for i, c in enumerate(chains)]
    field = Q.train(chains, labels)
    assert [field.decode(c) for c in chains] == labels


def test_verdicts_on_unseen_rows(spark):
    texts = [(i, good(i), 1) if i % 2 else (i, poor(i), 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts if i < 40], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in Q.judge(docs, Q.fit(docs, labels)).collect()}
    assert all(out[i]["kept"] == bool(q) for i, _, q in texts)


def test_base_measures_nulls_repeats_and_empty_tables(spark):
    field = Q.train([], [])
    text = "Ünï #1 <b>\n\nÜnï #1 <b>\n  \n" + "w " * 60
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0), (3, "", 0), (4, " \n ", 0)], "doc_id long, text string, kept int")
    out = Q.judge(docs, field).collect()
    words = text.split()
    for r in (r for r in out if r["doc_id"] == 1):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), 6, 1)
        assert r["n_repeat_words"] == repeated_words(words)
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in out if r["doc_id"] > 1)
    assert Q.judge(docs.limit(0), field).count() == 0


def test_training_ends_where_the_likelihood_has_no_slope():
    """Finite differences of a likelihood that sums over all label sequences vanish where the training ends."""
    rng = np.random.default_rng(3)
    chains = [[sorted(rng.choice(6, 2, replace=False).tolist()) for _ in range(n)] for n in (1, 3, 4, 2, 4)]
    labels = [rng.integers(0, 2, len(c)).tolist() for c in chains]
    total = sum(map(len, chains))

    def objective(w):
        emit, move = w[:-4].reshape(Q.FEATURES, 2), w[-4:].reshape(2, 2)

        def score(chain, own):
            s = sum(emit[f, y] for features, y in zip(chain, own, strict=True) for f in features)
            return s + sum(move[a, b] for a, b in zip(own, own[1:], strict=False))

        likelihood = sum(score(c, y) - np.logaddexp.reduce([score(c, z) for z in product((0, 1), repeat=len(c))]) for c, y in zip(chains, labels, strict=True))
        return likelihood / total - 1e-3 / 2 * float(w @ w)

    field = Q.train(chains, labels, rounds=300)
    w = np.concatenate((field.emit.ravel(), field.move.ravel()))
    used = [i for i in range(len(w)) if i < 12 or i >= len(w) - 4]
    step = 1e-5
    slope = [(objective(w + step * np.eye(len(w))[i]) - objective(w - step * np.eye(len(w))[i])) / (2 * step) for i in used]
    assert np.abs(slope).max() < 1e-3
    away = w + rng.normal(size=len(w)) * 0.3 * np.isin(np.arange(len(w)), used)
    assert objective(away) < objective(w)


def test_very_long_texts_ties_and_repeated_labels(spark):
    """A long text is judged whole; a labelled id that many rows share gives one text to learn from."""
    long = "\n".join(good(i, 3) for i in range(2000))
    docs = spark.createDataFrame([(1, long), (2, "x" * 300_000), *((3, f"{good(7)} {i % 3}") for i in range(50))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, 1), (2, 0)], "doc_id long, quality int")
    field = Q.fit(docs, labels)
    out = {r["doc_id"]: r for r in Q.judge(docs, field).collect()}
    words = long.split()
    assert (out[1]["n_words"], out[1]["n_repeat_words"]) == (len(words), repeated_words(words)) and out[2]["n_words"] == 1
