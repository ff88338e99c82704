from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_language_id import STEMS, text
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_near_dup import brute_force as near
from tidemark.llm import byte_bpe, decontaminate
from tidemark.llm.words import plain_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, rejected int"


def corpus(spark, path):
    rng = random.Random(12)
    rows = []
    for i in range(90):
        lang = rng.choice(list(STEMS))
        body = "\n".join(text(lang, f"{i}-{k}", 25) for k in range(3))
        if i % 4 == 0:
            body = "Shared heading\n" + body
        rows.append((i, body, lang))
    items = [(k, text("bb", f"item{k}", 16)) for k in range(4)]
    rows += [(100, rows[5][1], rows[5][2]), (101, rows[6][1] + " one more", rows[6][2]), (102, None, "aa"), (103, "12 34 !!", "aa")]
    rows += [(104, rows[7][1] + "\n" + items[0][1], rows[7][2]), (105, items[1][1] + " so", "bb"), (106, text("cc", "x", 60) + " " + items[2][1], "cc")]
    full = [(i, t, k, "s", len(t or ""), "old", 1) for i, t, k in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = corpus(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {i: t for i, t, _ in rows}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    steps = dict(corpus_pipeline.STAGES)

    docs = steps["language_id"](spark, docs, str(tmp_path))
    kept = {i: t for i, t in kept.items() if i not in (102, 103)}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept
    assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]

    docs = steps["line_dedup"](spark, docs, str(tmp_path))
    kept = dict(zip(kept, (k for _, _, k in lines(list(kept.values()), 10)), strict=True))
    got = docs.collect()
    assert {r["doc_id"]: r["text"] for r in got} == kept
    assert all(r["n_chars"] == len(r["text"]) and r["kept_text"] == "old" for r in got)

    docs = steps["ngram_jaccard_join"](spark, docs, str(tmp_path))
    alone = {i for i, c, _ in near(list(kept.items())) if i == c}
    kept = {i: t for i, t in kept.items() if i in alone}
    assert 100 not in kept and 101 not in kept and 104 in kept or 7 in kept
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept

    docs = steps["decontaminate"](spark, docs, str(tmp_path))
    matcher, clean = decontaminate.ItemMatcher([(str(k), t) for k, t in items], 10), {}
    for i, t in kept.items():
        n, hit, _ = hits(t, items, 10)
        spans = matcher.match(plain_words(t))[0]
        assert sum(b - a for a, b in spans) == hit
        if 2 * hit <= n:
            clean[i] = decontaminate.without(t, spans) if hit else t
    assert 105 not in clean and clean[106] != kept[106]
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == clean

    out = steps["byte_bpe"](spark, docs, str(tmp_path)).collect()
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: np.frombuffer(r["ids_le"], "<u4").tolist() for r in out} == {i: library.encode_ordinary(t) for i, t in clean.items()}


def test_run_gives_what_its_stages_give_and_takes_empty_tables(spark, tmp_path):
    corpus(spark, tmp_path / "a")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert {"doc_id", "n_tokens", "ids_le"} <= set(found.columns) and 0 < found.count() < docs.count()
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{tmp_path}/a/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
