from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tidemark.llm import filter_audit


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, labels):
    """Applies the filters one by one, document by document."""
    facts = []
    for doc_id, text, source in docs:
        text, ws = text or "", _words(text)
        copy = any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, _ in docs)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                 "D": bool(set(text) & set("#$%&*|")), "E": copy}
        good = any(i == doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc_id and t == 1 for i, _, t in labels if i is not None)
        facts.append((source or "", fails, good, toxic))
    rows, shapley = {}, Counter()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [f for f in left if f[1][name]]
                left = [f for f in left if not f[1][name]]
                rows[part, "".join(order), step] = (
                    len(left), len(gone), sum(f[1][name] for f in own) - len(gone), sum(f[1][name] and sum(f[1].values()) == 1 for f in own),
                    sum(f[2] for f in gone), sum(f[3] for f in gone),
                )
                shapley[part, name] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def ours(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    q = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.flagged(d, filter_audit.text_flags())
    found = filter_audit.audit(filter_audit.flag_counts(rows, q)).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found}
    assert len(out) == len(found)
    return out


def _documents(n=120):
    rng = random.Random(12)
    texts = [
        None, "", "  ", "x " * 300, " ".join(f"w{i}" for i in range(250)), "Tab\tand\x0bline\nbreaks " * 60, "A" * 500, "é" * 40 + " Z",
        " ".join(f"w{i}" for i in range(199)), " ".join(f"w{i}" for i in range(200)), "# " + " ".join(f"v{i}" for i in range(300)), "long" * 200_000,
    ]
    return [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(n)]


def test_all_orders_equal_filtering_one_by_one(spark):
    """Null and repeated ids, null texts and parts, copies, very long texts, repeated and null labels."""
    docs = _documents()
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 40, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (8, 7, 7)]
    assert ours(spark, docs, labels) == brute(docs, labels)


def test_zeros_are_there_and_empty_tables_give_no_rows(spark):
    found = ours(spark, [(1, "one word", "only")], [])
    assert len(found) == 600 and found == brute([(1, "one word", "only")], [])
    assert ours(spark, [], []) == {}


def test_one_text_held_by_most_rows_keeps_its_smallest_id_alone(spark):
    docs = [(i, "the same text", f"s{i % 3}") for i in range(300, 0, -1)] + [(1, "the same text", "s0"), (500, "other", "s1")]
    found = ours(spark, docs, [])
    assert found["s1", "EABCD", 1][1] == 99  # 1 stands in s1 and in s0
    assert found["s0", "EABCD", 1][:2] == (1, 100)
    assert found == brute(docs, [])


def test_extra_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "x y", "s", 1, True, "d")], "doc_id long, text string, source string, n long, A boolean, digest string")
    q = spark.createDataFrame([(1, 1, 1, "p")], "doc_id long, quality int, toxic int, part string")
    rows = filter_audit.flagged(d, filter_audit.text_flags())
    assert filter_audit.audit(filter_audit.flag_counts(rows, q)).count() == 600


@pytest.mark.parametrize("names", ["AB", "ABCDE"])
def test_survivors_of_a_subset(spark, names):
    """Every subset's survivors, for flags dealt at random, against a count."""
    rng = random.Random(len(names))
    rows = [("p", *(rng.random() < 0.4 for _ in names), 1, 0, 0) for _ in range(200)]
    counts = spark.createDataFrame(rows, "part string, " + ", ".join(f"{c} boolean" for c in names) + ", n long, good long, toxic long")
    found = {r["subset"]: r["n"] for r in filter_audit.survivors(counts, names).collect()}
    for subset in range(1 << len(names)):
        assert found.get(subset, 0) == sum(not any(r[1 + i] for i in range(len(names)) if subset >> i & 1) for r in rows)


def test_shapley_shares_add_up(spark):
    """Over all orders, what the filters remove together is what isn't kept at the end."""
    docs = _documents(60)
    found = ours(spark, docs, [])
    for part in {k[0] for k in found}:
        own = sum(1 for d in docs if (d[2] or "") == part)
        shares = {k[1][k[2] - 1]: v[6] for k, v in found.items() if k[0] == part}
        assert sum(shares.values()) == 120 * (own - found[part, "ABCDE", 5][0])
