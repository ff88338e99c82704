from __future__ import annotations

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_dup
from tidemark.llm.components import components


def shingles(text):
    """Sets of word tuples, made without the operator's words or hashes."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def links_of(rows, asked, threshold=0.8):
    """Pairs of places, one of them asked for, whose similarity reaches the threshold."""
    sets = [shingles(t) for _, t in rows]
    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = set()
    for i in asked:
        shared = {}
        for x in sets[i]:
            for j in by_shingle[x]:
                if j != i:
                    shared[j] = shared.get(j, 0) + 1
        pairs |= {(min(i, j), max(i, j)) for j, n in shared.items() if 10 * n >= 10 * threshold * (len(sets[i]) + len(sets[j]) - n)}
    return pairs


def brute_force(rows, threshold=0.8):
    """Links and class of each row by comparing all pairs."""
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links_of(rows, range(n), threshold):
        links[i] += 1
        links[j] += 1
        parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((rows[i][0], rows[min(k for k in range(n) if root(k) == root(i))][0], links[i]) for i in range(n))


def family(seed: int, copies: int, words: int = 120, edits: int = 2):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(99999)}"
        yield " ".join(own)


def found_by(spark, rows):
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found.collect())


def test_depth_is_the_longest_that_reaches_the_recall():
    assert near_dup.depth_for(0.998, 0.8, trees=16) == 5
    assert near_dup.depth_for(near_dup.RECALL, near_dup.THRESHOLD) == 4
    assert near_dup.depth_for(0.9999999999, 0.8, trees=16) < 4
    assert near_dup.depth_for(0.5, 0.8) == near_dup.LABEL


def test_expected_recall_needs_many_or_very_similar_links(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, None), (1, 0.97), (2000, 0.97), (2000, 0.81)], "n long, least double")
    at = lambda depth: [r[0] for r in df.select(near_dup.expected_recall(F.col("n"), F.col("least"), depth, 0.8)).collect()]
    assert [x >= near_dup.RECALL for x in at(8)] == [False, False, True, False]
    assert [x >= near_dup.RECALL for x in at(4)] == [False, True, True, True]


def test_sorted_tries_keep_the_labels_that_meet_somebody(spark):
    rows = [(i, t) for i, t in enumerate([*family(3, 40), *(" ".join(f"q{i}{k}" for k in range(30)) for i in range(60))])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_dup.signatures(docs, "text", "doc_id", 5).dropDuplicates(["node"])
    labels = {r["node"]: r["labels"] for r in nodes.collect()}
    cut = lambda b, t, d: bytes(b[32 * t : 32 * t + 4 * d])
    got = {(r["tree"], bytes(r["node"])): r["longest"] for r in near_dup.tries(nodes.repartition(3), 4).collect()}
    for t in range(near_dup.TREES):
        for node, own in labels.items():
            longest = max(next((d for d in range(8, 0, -1) if cut(own, t, d) == cut(other, t, d)), 0) for n, other in labels.items() if n != node)
            if longest >= 4:
                assert got[t, bytes(node)] >= longest
            elif (t, bytes(node)) in got:
                assert got[t, bytes(node)] == 8  # at a cut of the sort
    assert len(got) < near_dup.TREES * len(labels) / 2


def test_equals_brute_force_with_copies_families_and_odd_rows(spark):
    texts = [t for s in range(12) for t in family(s, 6)] + list(family(99, 300, words=60))
    texts += ["one two", "one two", "", None, "!!!", "a b c d e", "A, b; c d E"] + [f"alone {i} " + " ".join(f"q{i}{k}" for k in range(30)) for i in range(40)]
    long = [f"l{random.Random(4).randrange(99)}{k}" for k in range(60_000)]
    texts += [" ".join(long), " ".join(long[500:]), " ".join(long[20_000:])]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert found_by(spark, rows) == brute_force(rows)


def test_crowds_are_met_at_shrinking_depths_and_each_link_counts_once(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    depths, verified = [], near_dup.verified_links

    def watched(*args):
        out = verified(*args)
        depths.append({r["depth"]: r["n"] for r in out.groupBy("depth").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()})
        return out

    monkeypatch.setattr(near_dup, "verified_links", watched)
    rows = list(enumerate([*family(5, 420, words=100, edits=1), *family(6, 3)]))
    assert found_by(spark, rows) == brute_force(rows)
    # Most pairs at 0.8 share eight values in some tree; a few share six or seven at most.
    assert depths[0][8] > depths[0][6] > 0 and near_dup.depths(4) == [4, 6, 8]


def test_nodes_of_reached_recall_are_not_compared_at_shorter_prefixes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    cells, blocks = {}, near_dup._blocks

    def watched(crowd, members, found, depth, *rest):
        out = blocks(crowd, members, found, depth, *rest)
        cells[depth] = out.count()
        return out

    monkeypatch.setattr(near_dup, "_blocks", watched)
    rows = list(enumerate(family(5, 150, words=600, edits=1)))
    want = brute_force(rows)
    near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(cells[d] > 0 for d in (8, 6, 4))
    cells.clear()
    # A target that few strong links reach: what stays is found at the longest prefixes, and no class falls apart.
    monkeypatch.setattr(near_dup, "depth_for", lambda recall, threshold: 4)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99)
    assert {(r["doc_id"], r["class_id"]) for r in found.collect()} == {(i, c) for i, c, _ in want}
    assert cells[8] > 0 and not any(cells[d] for d in (6, 4))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_given_documents(spark, sf):
    """Every id divisible by 100 against all rows: no link lost and none too many."""
    path = f"/root/testdata/sf{sf}/documents.parquet"
    table = pq.read_table(path, columns=["doc_id", "text"])
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    asked = [i for i, (d, _) in enumerate(rows) if d % 100 == 0]
    want = dict.fromkeys((rows[i][0] for i in asked), 0)
    for i, j in links_of(rows, asked):
        for x in {i, j} & set(asked):
            want[rows[x][0]] += 1
    found = near_dup.near_duplicates(spark.read.parquet(path).select("doc_id", "text")).where("doc_id % 100 = 0")
    assert {r["doc_id"]: r["n_links"] for r in found.collect()} == want
    assert sf == "0.01" or sum(want.values()) >= 20


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (3, text), (3, text), (4, None)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"], r["n_links"]) for r in found) == [(-1, 3, 3), (-1, 3, 3), (3, 3, 3), (3, 3, 3), (4, 4, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string, node string, prefixes int")
    assert near_dup.near_duplicates(empty).count() == 0


def test_a_shared_id_costs_no_more_than_a_unique_one(spark):
    """Hundreds of different texts under one id, null or not: each node's text is found once, not once for every row."""
    rng = random.Random(9)
    texts = []
    for i in range(300):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        texts += [" ".join(words), " ".join([*words, f"end{i}"])]
    rows = []
    for i, t in enumerate(texts):
        rows.append((None if i < 300 else 7, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_dup.signatures(docs, "text", "doc_id", 5).select("node", F.col("row_id").alias("rep"), "ta", "tb")
    found = near_dup._sets(docs, signed, "text", "doc_id", 5)
    assert found.count() == found.select("node").distinct().count() == 600
    out = near_dup.near_duplicates(docs).collect()
    assert len(out) == 600 and {r["n_links"] for r in out} == {1}
    assert {r["class_id"] for r in out} == {None, 7}


def test_one_of_each_keeps_the_least_id_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text, "x", 1), (2, text + " end", "y", 2), (9, "else", "z", 3), (9, "else", "z", 3)]
    left = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, ta string, kept int"))
    assert left.columns == ["doc_id", "text", "ta", "kept"]
    assert sorted(map(tuple, left.collect())) == [(2, text + " end", "y", 2), (9, "else", "z", 3)]


def test_one_of_each_keeps_a_single_row_of_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text), (2, text), (None, "other words here"), (None, "other words here"), (5, ""), (6, text + " end")]
    left = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left) == [(-1, "other words here"), (2, text), (5, "")]


def test_one_of_each_tells_rows_apart_whose_id_is_null_or_repeated(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"]
    a, b, c, d, e, f, g = texts
    rows = [(1, a), (None, a + " end"), (None, b), (None, c), (None, c + " end"), (7, d), (7, e), (7, a), (8, e + " end"), (9, f), (9, f), (9, g), (None, None), (None, "")]
    left = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in left)
    assert [t for i, t in got if i == -1 and t in (c, c + " end")] in ([c], [c + " end"])
    assert [x for x in got if x[1] not in (c, c + " end")] == sorted([(1, a), (-1, b), (7, d), (7, e), (9, f), (9, g), (-1, ""), (-1, "")])


def test_rows_that_surely_stay_are_told_without_a_join(spark, monkeypatch):
    rows = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("row_id"), F.xxhash64("id").alias("ta"), "id")
    keys = rows.where("id % 10 = 0").select("row_id", "ta")
    found = near_dup._perhaps(rows, keys, ["row_id", "ta"])
    assert found.columns == ["row_id", "ta", "id", "perhaps"] and found.count() == 5000
    others = {r["id"] for r in found.where("perhaps").collect()} - set(range(0, 5000, 10))
    assert found.where("perhaps AND id % 10 = 0").count() == 500 and len(others) < 500
    assert near_dup._perhaps(rows, keys.limit(0), ["row_id", "ta"]).where("perhaps").count() == 0
    # A full bitmap only moves more rows: what stays is the same.
    met, perhaps = [], near_dup._perhaps
    monkeypatch.setattr(near_dup, "_perhaps", lambda *args: met.append(1) or perhaps(*args))
    docs = spark.createDataFrame([(i, f"own{i // 2} " * 3) for i in range(40)] + [(None, "x y"), (None, "x y")], "doc_id long, text string")
    left = []
    for most in (1 << 29, 1):
        monkeypatch.setattr(near_dup, "_MOST_BITS", most)
        left.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near_dup.one_of_each(docs).collect()))
    assert left[0] == left[1] == [(False, i) for i in range(0, 40, 2)] + [(True, 0)] and len(met) == 2


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    from tidemark.llm import components as C

    rounds, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: (rounds.append(name), stored(df, name))[1])
    edges = spark.range(999).selectExpr("id AS u", "id + 1 AS v").unionByName(spark.createDataFrame([(5000, 5001), (6000, 6000)], "u long, v long"))
    out = components(edges).collect()
    assert len(out) == 1002 and len({r["root"] for r in out if r["u"] < 1000}) == 1 and len({r["root"] for r in out}) == 2
    assert rounds.count("hooks") <= 15
