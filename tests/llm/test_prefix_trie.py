from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(conversations: dict[int, list[tuple[str, str]]]):
    """A trie by plain prefixes: (conv_id, depth) -> the other columns."""
    members = {}
    for c in sorted(conversations):
        for d in range(len(conversations[c]) + 1):
            members.setdefault(tuple(conversations[c][:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own = kids.get(p, [])
        below[p] = (sum(below[k][0] for k in own) or 1, sum(below[k][1] for k in own) + (len(members[p]) - 1) * words(p))
    out = {}
    for p, own in members.items():
        ends = ",".join(str(c) for c in own if len(conversations[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out[own[0], len(p)] = (parent, len(own), len(kids.get(p, [])), *below[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def read(rows) -> dict[int, list[tuple[str, str]]]:
    out = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            out.setdefault(c, []).append(((turn is not None, turn or 0), key, role, text))
    return {c: [(r, t) for _, _, r, t in sorted(own)] for c, own in out.items()}


def rebuilt(own, heads=4):
    def one(c):
        h = zlib.crc32(str(c).encode()) % heads
        return own.get(c - c % 20, [])[:h] + own[c][h:]

    return {c: one(c) for c in own}


def collected(df):
    rows = df.collect()
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def _rows(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        start = rng.choice([[], [("system", "be kind")], [("system", "be kind"), ("user", "hi there")], [(None, None), ("user", "")]])
        said = start + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "a b\tc", "é 🙂", None])) for _ in range(rng.randint(0, 5))]
        rows += [(c, t, *x) for t, x in enumerate(said)]
    return rows


def test_the_trie_equals_plain_prefixes(spark):
    """Null turns, roles, texts and conversations, ties, repeated rows, gaps in turns, long texts, negative ids."""
    rows = _rows() + [(100, None, "user", "first"), (100, 5, "user", "later"), (100, 5, "user", "later"), (100, 5, "assistant", "tie"), (None, 1, "user", "x"),
                      (-7, 0, "user", "w " * 100_000), (-8, 0, "user", "w " * 100_000), (101, 3, "user", "only")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(prefix_trie.prefix_trie(df)) == brute(read(rows))


def test_rebuilt_conversations_equal_plain_ones(spark):
    """Parents that are absent or short, and conversations of which nothing is left."""
    rows = [r for r in _rows(2, 90) if r[0] not in (40, 60)] + [(200, 0, "user", "a"), (213, 0, "user", "b"), *((c, 0, "user", "z") for c in range(61, 80))]
    own = read(rows)
    assert any(not x for x in rebuilt(own).values())
    found = prefix_trie.fingerprints(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA)))
    assert collected(prefix_trie.nodes(prefix_trie.spliced(found))) == brute(rebuilt(own))


def test_an_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 5, "s", 1)], SCHEMA + ", depth long, salt string, conv long")
    assert collected(prefix_trie.prefix_trie(df)) == brute({1: [("user", "x")]})
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.nodes(prefix_trie.spliced(prefix_trie.fingerprints(prefix_trie.turns(df.limit(0))))).count() == 0


@pytest.mark.parametrize("field", [((7, 3), (5, 2)), ((2, 1), (3, 1))])
def test_colliding_fingerprints_are_split(spark, field):
    """Fingerprints of a few values make most candidates collide, at many depths of one conversation."""
    rows = _rows(4, 50)
    assert collected(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), field=field)) == brute(read(rows))


def test_colliding_digests_are_split_by_the_texts_themselves(spark, monkeypatch):
    def weak(role, text):
        return F.unhex(F.lpad(F.hex(F.char_length(text) % 2), 32, "0"))

    rows = [(c, t, r, x) for c, t, r, x in _rows(5, 30)]
    expected = brute(read(rows))
    for bound in (200_000, 0):  # repeated digests broadcast, and all texts aggregated
        monkeypatch.setattr(prefix_trie, "BROADCAST", bound)
        assert collected(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), digest=weak)) == expected


def test_a_conversation_over_many_ranges_and_pieces(spark, monkeypatch):
    """One conversation holds most turns: ranges begin inside it, and its depths are summed in pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    monkeypatch.setattr(prefix_trie, "PACK", 4)
    rng = random.Random(6)
    long = [("user" if t % 2 else "assistant", f"turn {rng.randrange(5)}") for t in range(700)]
    rows = [(c, t, *x) for c in (0, 5, 9) for t, x in enumerate(long[: 700 - 60 * c])] + [(c, 0, "user", "short") for c in range(20, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = prefix_trie.fingerprints(prefix_trie.turns(df))
        assert collected(prefix_trie.prefix_trie(df)) == brute(read(rows))
        assert found.groupBy("conv").agg(F.max("depth").alias("n")).where("conv = 0").first()["n"] == 700
    finally:
        for k, v in (("spark.sql.adaptive.coalescePartitions.enabled", "true"), ("spark.sql.shuffle.partitions", "4"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")):
            spark.conf.set(k, v)


def test_a_parent_of_most_nodes_and_a_node_of_most_conversations(spark, monkeypatch):
    """The parent's name is found without joining the children of one node in one task (see _parents)."""
    rows = [(c, 0, "system", "one prompt") for c in range(3000)] + [(c, 1, "user", f"question {c}") for c in range(2500)]
    assert collected(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(read(rows))


def test_powers_far_along(spark):
    import numpy as np

    power = prefix_trie._Powers(*prefix_trie.FIELD[0])
    at = np.array([1, 2, 65535, 65536, 65537, 10_000_019])
    prime, base = prefix_trie.FIELD[0]
    assert power(at).tolist() == [pow(base, int(x), prime) for x in at]
