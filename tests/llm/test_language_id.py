from __future__ import annotations

import random

import numpy as np

from tidemark.llm import language_id as G

STEMS = {"aa": ["bal", "kor", "min", "tas"], "bb": ["öst", "ühl", "ärg", "schw"], "cc": ["ción", "ñez", "llo", "que"]}


def text(lang, seed, words=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def rows():
    return [(i, text(lang, i), lang) for i, lang in enumerate(k for k in STEMS for _ in range(40))]


def test_held_out_accuracy_and_unknowns(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = G.fit(docs.where(~G.held_out()))
    unseen = [(1000 + i, text(k, f"new{i}"), k) for i in range(20) for k in STEMS] + [(1, None, "aa"), (2, "123 !!", "aa"), (3, "", "aa")]
    out = G.identify(spark.createDataFrame(unseen, "doc_id long, text string, score string"), model).collect()
    named = [r for r in out if r["doc_id"] >= 1000]
    want = {d: k for d, _, k in unseen}
    by_id = {}
    for d, t, k in unseen:
        by_id.setdefault(t, k)
    assert np.mean([r["lang_pred"] == by_id[r["text"]] for r in named]) > 0.98
    assert all(0 <= r["score"] <= 1 and not r["rejected"] for r in named)
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in out if r["doc_id"] < 1000} == {("und", 0.0, True)}
    assert want


def test_predictions_equal_a_plain_search_of_centroids(spark):
    """Trigrams, weights and cosines by dictionaries, over every centroid."""
    import math
    from collections import Counter

    model = G.fit(spark.createDataFrame(rows(), "doc_id long, text string, lang string"))
    for text_ in [text(k, f"plain{i}", 5 + 7 * i) for i in range(12) for k in STEMS] + ["Kor, BAL-min", "qq zz"]:
        raw = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in (" " + text_.lower() + " ").encode())
        grams = Counter(raw[i : i + 3] for i in range(len(raw) - 2) if raw[i : i + 3] != b"   ")
        dims = Counter()
        for g, n in grams.items():
            dims[int.from_bytes(g, "big") * 2654435761 % 2**32 >> 18] += n
        weight = {d: (1 + math.log(n)) * float(model.idf[d]) for d, n in dims.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        cosines = [(sum(w * float(c[d]) for d, w in weight.items()) / norm, lang) for c, lang in zip(model.centroids, model.languages, strict=True)]
        best = max(c for c, _ in cosines)
        lang, score, _ = model.predict(text_)
        assert abs(score - best) < 1e-4 and lang in {k for c, k in cosines if c > best - 1e-4}


def test_junk_is_rejected_and_clean_texts_stay(spark):
    """Over the given documents: a model as op1 learns it, own junk of three kinds, and held-out texts of ordinary words."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = G.fit(docs.where(~G.held_out()))
    rng = random.Random(3)
    unseen = docs.where(G.held_out()).where("text IS NOT NULL").select("text", "lang").collect()
    clean = [r for r in unseen if len(set(r["text"].split())) > 0.5 * len(r["text"].split()) and sum(map(str.isalpha, r["text"])) > 0.7 * len(r["text"])]
    assert len(clean) > 1000
    found = [model.predict(r["text"]) for r in clean]
    assert np.mean([not f[2] for f in found]) > 0.99
    assert np.mean([f[0] == r["lang"] for f, r in zip(found, clean, strict=True)]) > 0.99
    words = [w for r in clean[:200] for w in r["text"].split()]
    scripts = [(0x3B1, 24), (0x430, 32), (0x5D0, 27), (0x627, 26), (0x905, 50), (0x4E00, 2000)]
    junk = [" ".join([rng.choice(words)] * rng.randrange(60, 400)) for _ in range(100)]
    junk += ["".join(rng.choice("!#$%&*+-/<=>?@^_|~ 0123456789") for _ in range(rng.randrange(5, 300))) for _ in range(100)]
    for first, n in scripts:
        junk += [" ".join("".join(chr(first + rng.randrange(n)) for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(20, 120))) for _ in range(20)]
    junk += [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(30, 120))) for _ in range(100)]
    gone = [model.predict(t)[2] for t in junk]
    assert [np.mean(gone[a : a + 100]) > 0.9 for a in (0, 100, 320)] == [True] * 3 and np.mean(gone[200:320]) > 0.9


def test_repeated_ids_and_rows_and_very_long_texts(spark):
    many = rows() + rows()[:5] * 30 + [(2, text("aa", f"other{i}"), "aa") for i in range(40)]
    model = G.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    long = text("bb", "long", 400_000)
    out = G.identify(spark.createDataFrame([(1, long), (1, long), (1, None)], "doc_id long, text string"), model).collect()
    assert [(r["lang_pred"], r["rejected"]) for r in out].count(("bb", False)) == 2 and len({r["score"] for r in out}) == 2


def test_far_texts_are_rejected(spark):
    model = G.fit(spark.createDataFrame(rows(), "doc_id long, text string, lang string"))
    assert model.predict("zxqj vvkp wyzx " * 100)[2]
    assert not model.predict(text("aa", "other", 200))[2]


def test_the_sample_is_bounded_and_does_not_depend_on_order(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    few = G.sample_rows(docs, 16, "lang", "doc_id")
    assert few.count() <= 3 * 16
    a = {r[0] for r in few.collect()}
    assert a == {r[0] for r in G.sample_rows(docs.orderBy("text").repartition(7), 16, "lang", "doc_id").collect()}


def test_no_labels_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", None), (None, "abc", "aa"), (2, None, "bb")], "doc_id long, text string, lang string")
    model = G.fit(docs)
    out = G.identify(docs, model).collect()
    assert {r["lang_pred"] for r in out} == {"und"}
    assert G.identify(docs.limit(0), model).count() == 0


def test_kmeans_finds_separate_directions():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.eye(4)[k] + 0.05 * rng.random((20, 4)) for k in range(3)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(G.spherical_kmeans(x, 3).argmax(1).tolist()) == [0, 1, 2]
