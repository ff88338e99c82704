from __future__ import annotations

import random
import zlib

from tidemark.llm import sharding as S


def plain_best_fit(sizes, capacity):
    """Best fit decreasing by looking at every bin."""
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(left, b) for b, left in enumerate(bins) if left >= sizes[i]]
        if fits:
            _, b = min(fits)
        else:
            b = len(bins)
            bins.append(max(capacity, sizes[i]))
        bins[b] -= sizes[i]
        out[i] = b
    return out


def test_tree_packs_like_a_plain_search():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(80))]
        got = S.best_fit_decreasing(sizes, 64)
        assert got == plain_best_fit(sizes, 64)
        assert len(set(got)) <= 11 / 9 * S.packing_bound(sizes, 64) + 1 if sizes else True


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string")


def test_laws(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randrange(400) for _ in range(600)] + ["copy ü " * 20] * 60 + [None, None, ""]
    rows = [(i, t, "old") for i, t in enumerate(texts)]
    out = S.shard(docs_of(spark, rows), shards=16).collect()
    assert len(out) == len(rows)
    by_text, load, slots = {}, {}, {}
    for r in out:
        text = texts[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 1
        assert r["text_crc32"] == zlib.crc32((text or "").encode())
        by_text.setdefault(text, set()).add(r["shard"])
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert set(load) <= set(range(16))
    (copies,) = by_text["copy ü " * 20]  # more bytes than a shard's share: they fill one alone
    rest = [v for k, v in load.items() if k != copies]
    assert len(rest) == 15 and max(rest) - min(rest) < 0.02 * max(rest)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fixed_capacity_opens_as_few_bins_as_it_can(spark):
    rows = [(i, chr(97 + i) * n, "") for i, n in enumerate([9, 9, 9, 9, 4, 4, 4, 4])]
    got = S.assign(S.sized(docs_of(spark, rows)), capacity=20).groupBy("shard").sum("size").collect()
    assert all(r[1] <= 20 for r in got) and len(got) == 3


def test_small_groups_fill_many_shards_of_a_given_capacity(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, f"{i}:" + "x" * rng.randrange(60), "") for i in range(12_000)]
    sizes = [len(t) + 1 for _, t, _ in rows]
    for at_once in (S.AT_ONCE, 3000):
        monkeypatch.setattr(S, "AT_ONCE", at_once)
        got = S.assign(S.sized(docs_of(spark, rows)), capacity=80).groupBy("shard").sum("size").collect()
        assert sum(r[1] for r in got) == sum(sizes)
        assert all(r[1] <= 80 for r in got)
        assert {r[0] for r in got} == set(range(len(got)))
        assert len(got) <= 11 / 9 * S.packing_bound(sizes, 80) + 5


def test_groups_larger_than_a_shard_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "big" * 100, ""), (None, "big" * 100, ""), (1, "a", ""), (1, "a", "")]
    out = S.shard(docs_of(spark, rows), shards=2).collect()
    assert len(out) == 4 and len({r["shard"] for r in out}) == 2
    assert S.shard(docs_of(spark, []), shards=4).count() == 0
