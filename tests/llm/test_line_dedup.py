from __future__ import annotations

from collections import Counter

import pytest

from tidemark.llm import line_dedup as L

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(texts, min_docs, min_chars=1):
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(UPPER) for line in (t or "").split("\n")] for t in texts]
    n = Counter(k for own in keys for k in set(own))
    gone = {k for k, v in n.items() if v >= min_docs and len(k) >= min_chars}
    out = []
    for t, own in zip(texts, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, own, strict=True) if k not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


TEXTS = [
    "Same line\nalone 1", " same LINE \t\nalone 2", "same line", None, "", "\n\n", "ÄRGER\nsame line\nsame line", "ärger\nx", " same line\nend\n", "a" * 50_000 + "\nsame line",
]


@pytest.mark.parametrize(("inline", "broadcast"), [(L.INLINE, 0), (0, L.BROADCAST), (0, 0)])
def test_all_ways_equal_brute_force(spark, inline, broadcast):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    out = L.drop_frequent_lines(docs, min_docs=3, inline=inline, broadcast=broadcast).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"], r["kept_text"] or "") for r in out] == brute(TEXTS, 3)


@pytest.mark.parametrize("inline", [L.INLINE, 0])
def test_nulls_repeats_clashing_columns_and_empty_tables(spark, inline):
    rows = [(None, "hot\nx", "a", 1), (None, "hot\ny", "b", 1), (1, "hot\nz", "c", 1), (1, "hot\nz", "c", 1), (2, None, "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, stay int")
    out = L.drop_frequent_lines(docs, min_docs=4, inline=inline).collect()
    assert {r["stay"] for r in out} == {1}
    assert sorted((r["kept_text"] or "", r["n_dropped"]) for r in out) == [("", 0), ("x", 1), ("y", 1), ("z", 1), ("z", 1)]
    assert L.drop_frequent_lines(docs.limit(0), inline=inline).count() == 0


def test_only_built_in_functions(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = L.drop_frequent_lines(docs, min_docs=1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
