"""Version logs, frozen contexts, parsed rows by digest, backtests of many cut-offs, experiments whose stages are kept."""

from __future__ import annotations

import random
import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.ml import harness
from tidemark.operators import backtest, versions
from tidemark.sources import parsed as P


# Versions


def test_of_two_writers_one_wins_and_the_other_is_told(spark, tmp_path):
    root, barrier, out = f"file://{tmp_path}/log", threading.Barrier(6), []

    def write(i):
        barrier.wait()
        try:
            out.append(("won", i, versions.commit(spark, root, {"by": i}, 0)))
        except versions.Conflict:
            out.append(("told", i, None))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [i for kind, i, _ in out if kind == "won"]
    assert len(winners) == 1 and len(out) == 6
    assert versions.entries(spark, root) == [{"number": 1, "by": winners[0]}]


def test_appends_at_once_all_get_a_number(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    threads = [threading.Thread(target=lambda i=i: versions.append(spark, root, {"by": i})) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = versions.entries(spark, root)
    assert [e["number"] for e in found] == list(range(1, 9)) and {e["by"] for e in found} == set(range(8))


def test_a_pinned_reader_sees_what_it_saw(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    assert versions.add_rows(rows(1, 2), root, {"run": "a"}) == 1
    seen = versions.table_at(spark, root, 1)
    assert versions.add_rows(rows(3), root, after=1) == 2
    assert sorted(r["i"] for r in seen.collect()) == sorted(r["i"] for r in versions.table_at(spark, root, 1).collect()) == [1, 2]
    assert sorted((r["i"], r["version"]) for r in versions.table_at(spark, root).collect()) == [(1, 1), (2, 1), (3, 2)]
    with pytest.raises(versions.Conflict):
        versions.add_rows(rows(4), root, after=1)
    assert versions.table_at(spark, root).count() == 3  # the refused rows are seen by nobody
    with pytest.raises(ValueError, match="no entry 9"):
        versions.commit(spark, f"{root}/log", {}, 9)
    assert versions.read(spark, f"{root}/log", 1)["run"] == "a"


def test_a_frozen_context_can_only_be_the_same(spark, tmp_path):
    root, context = f"file://{tmp_path}/contexts", {"window": [2001, 2021, 2025], "metric": "mae"}
    mark = versions.freeze(spark, root, context)
    assert versions.freeze(spark, root, dict(reversed(context.items()))) == mark
    versions.require_frozen(spark, root, mark, context)
    with pytest.raises(ValueError, match="metric"):
        versions.require_frozen(spark, root, mark, context | {"metric": "rmse"})
    with pytest.raises(KeyError):
        versions.require_frozen(spark, root, "0" * 64, context)
    (tmp_path / "contexts" / f"{mark}.json").write_text('{"metric": "mae"}')
    with pytest.raises(ValueError, match="changed"):
        versions.require_frozen(spark, root, mark, {"metric": "mae"})


# Parsed rows by digest


def _files(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").withColumn("digest", F.sha2("text", 256))


def _words(files):
    return files.select("digest", F.explode(F.split("text", " ")).alias("word")).where("word != ''")


def test_a_second_run_parses_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/parsed"
    assert P.parsed(spark, root, "words", "1") is None
    assert P.parse_new(_files(spark, "a b", "c", "a b", ""), _words, root, "words", "1") == 3

    def never(files):
        raise AssertionError("parsed again")

    assert P.parse_new(_files(spark, "c", "a b", ""), never, root, "words", "1") == 0
    assert P.parse_new(_files(spark, "c", "d"), _words, root, "words", "1") == 1
    assert sorted(r["word"] for r in P.parsed(spark, root, "words", "1").collect()) == ["a", "b", "c", "d"]
    assert P.parse_new(_files(spark, "c"), _words, root, "words", "2") == 1  # another version has its own rows
    asked = P.parsed(spark, root, "words", "1", _files(spark, "c", "unknown").select("digest"))
    assert [r["word"] for r in asked.collect()] == ["c"]


def test_a_run_that_dies_leaves_nothing_half(spark, tmp_path):
    root = f"file://{tmp_path}/parsed"
    P.parse_new(_files(spark, "a"), _words, root, "words", "1")

    def dies(files):
        return _words(files).withColumn("word", F.raise_error(F.lit("out of paper")))

    with pytest.raises(Exception, match="out of paper"):
        P.parse_new(_files(spark, "b"), dies, root, "words", "1")
    assert [r["word"] for r in P.parsed(spark, root, "words", "1").collect()] == ["a"]
    assert P.parse_new(_files(spark, "b"), _words, root, "words", "1") == 1
    assert P.parsed(spark, root, "words", "1").count() == 2


def test_runs_at_once_and_compaction_keep_one_copy(spark, tmp_path):
    root = f"file://{tmp_path}/parsed"
    errors = []

    def one(text):
        try:
            P.parse_new(_files(spark, "same", text), _words, root, "words", "1")
        except Exception as e:  # shown below
            errors.append(e)

    threads = [threading.Thread(target=one, args=(t,)) for t in ("x", "y", "z")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    words = lambda: sorted(r["word"] for r in P.parsed(spark, root, "words", "1").collect())
    assert words() == ["same", "x", "y", "z"]
    before = P.parsed(spark, root, "words", "1")
    assert P.compact(spark, root, "words", "1") in (2, 3)
    assert words() == ["same", "x", "y", "z"] and before.count() == 4
    assert P.compact(spark, root, "words", "1") == 0 and P.parse_new(_files(spark, "x"), _words, root, "words", "1") == 0
    with pytest.raises(ValueError, match="folder"):
        P.parsed(spark, root, "../words", "1")


# Backtests


def _history(spark, seed=3, n=200):
    rng = random.Random(seed)
    rows = [(rng.choice([*range(12), None]), date(2020, 1, 1) + timedelta(days=rng.randrange(900)), rng.choice([None, *map(float, range(50))]), rng.choice("xyz")) for _ in range(n)]
    rows += [(3, None, 1.0, "x"), (99, date(2030, 1, 1), 5.0, "x")]
    return rows, "e long, d date, v double, s string"


CUTS = [date(2020, 6, 30), date(2021, 6, 30), date(2020, 12, 31), date(2022, 6, 30), date(2021, 6, 30)]


def test_states_equal_looking_back_from_each_cutoff(spark):
    rows, schema = _history(spark)
    found = {(r["e"], r["cutoff"]): r for r in backtest.replay(spark.createDataFrame(rows, schema), CUTS, "e", "d", "v", horizon=200).collect()}
    expected = 0
    for e in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == e and r[1]), key=lambda r: (r[1], r[2] is not None, r[2] or 0))
        for cut in set(CUTS):
            past = [r for r in own if r[1] <= cut]
            if not past:
                assert (e, cut) not in found
                continue
            expected += 1
            r = found[e, cut]
            values = [x[2] for x in past if x[2] is not None]
            after = [x for x in own if x[1] > cut and x[2] is not None]
            assert (r["n"], r["total"], r["last_day"], r["known"]) == (len(values), sum(values) if values else None, past[-1][1], values[-1] if values else None)
            want = (after[0][1], after[0][2]) if after and (after[0][1] - cut).days <= 200 else (None, None)
            assert (r["next_day"], r["actual"]) == want
    assert len(found) == expected


def test_what_comes_later_changes_no_state(spark):
    rows, schema = _history(spark, 4)
    state = lambda data: sorted(tuple(r)[:6] for r in backtest.replay(spark.createDataFrame(data, schema), CUTS[:3], "e", "d", "v", ("s",)).select("e", "cutoff", "n", "total", "last_day", "known", "s").collect())
    early = [r for r in rows if r[1] is None or r[1] <= max(CUTS[:3])]
    later = early + [(r[0], max(CUTS[:3]) + timedelta(days=1 + i % 50), 1e9, "z") for i, r in enumerate(rows) if r[0] is not None]
    assert state(early) == state([r for r in later if (r[0], ) in {(x[0],) for x in early}])


def test_entities_have_no_cutoffs_after_their_end(spark):
    rows = [(1, date(2020, 1, 1), 1.0, date(2021, 1, 1)), (2, date(2020, 1, 1), 1.0, None)]
    found = backtest.replay(spark.createDataFrame(rows, "e long, d date, v double, over date"), CUTS, "e", "d", "v", end="over").collect()
    assert sorted((r["e"], r["cutoff"]) for r in found) == sorted([(1, c) for c in set(CUTS) if c < date(2021, 1, 1)] + [(2, c) for c in set(CUTS)])


def test_a_report_by_hand(spark):
    states = spark.createDataFrame([(1, date(2020, 1, 1), 10.0, 8.0), (2, date(2020, 1, 1), 2.0, 9.0), (3, date(2020, 1, 1), 1.0, None)], "e long, cutoff date, known double, actual double")
    written = backtest.predictions(states.withColumns({"total": F.col("known"), "last_day": F.lit(None)}), "e", F.col("known"), least=3.0)
    assert {(r["e"], r["predicted"], r["error"], round(r["accuracy"], 4), round(r["confidence"], 4)) for r in written.collect()} == {(1, 10.0, 2.0, 75.0, 66.6667), (2, 3.0, -6.0, 33.3333, 66.6667)}
    r = backtest.report(written, 8.5).first()
    assert (r["mae"], r["rows"], r["true_positive"], r["false_positive"], r["false_negative"], r["true_negative"], r["precision"], r["recall"]) == (4.0, 2, 0, 1, 1, 0, 0.0, 0.0)


# Experiments


def test_changing_one_stage_runs_that_and_what_follows(spark, tmp_path):
    ran = []

    def double(df, by):
        ran.append("double")
        return df.withColumn("v", F.col("v") * by)

    def total(df):
        ran.append("total")
        return df.agg(F.sum("v").alias("v"))

    def other(df):
        ran.append("other")
        return df.where("v > 1")

    def graph(by):
        return [harness.Stage("total", total, ("double",)), harness.Stage("double", double, ("rows",), {"by": by}), harness.Stage("other", other, ("rows",))]

    root, rows = f"file://{tmp_path}/runs", spark.createDataFrame([(1,), (2,)], "v int")
    first = harness.run(spark, graph(2), {"rows": rows}, root)
    assert sorted(ran) == ["double", "other", "total"] and first["total"].frame.first()["v"] == 6
    again = harness.run(spark, graph(2), {"rows": rows.orderBy("v")}, root)
    assert len(ran) == 3 and all(e["reused"] for e in harness.evidence(again))
    third = harness.run(spark, graph(5), {"rows": rows}, root)
    assert sorted(ran[3:]) == ["double", "total"] and third["total"].frame.first()["v"] == 15 and third["other"].reused
    fourth = harness.run(spark, graph(5), {"rows": rows.union(rows)}, root)
    assert len(ran) == 8 and fourth["total"].frame.first()["v"] == 30


def test_a_stage_that_dies_is_run_again_and_bad_graphs_are_refused(spark, tmp_path):
    root, rows = f"file://{tmp_path}/runs", spark.createDataFrame([(1,)], "v int")
    fail = [True]

    def fragile(df):
        return df.withColumn("v", F.raise_error(F.lit("broke"))) if fail[0] else df

    stages = [harness.Stage("fragile", fragile, ("rows",))]
    with pytest.raises(Exception, match="broke"):
        harness.run(spark, stages, {"rows": rows}, root)
    fail[0] = False
    assert not harness.run(spark, stages, {"rows": rows}, root)["fragile"].reused
    with pytest.raises(ValueError, match="lacks"):
        harness.run(spark, [harness.Stage("a", fragile, ("b",)), harness.Stage("b", fragile, ("a",))], {}, root)
    with pytest.raises(ValueError, match="twice"):
        harness.run(spark, [harness.Stage("rows", fragile)], {"rows": rows}, root)


def test_the_query_takes_its_source_fingerprint_once(spark, monkeypatch):
    """Both runs of experiment_stages know the prices by one fingerprint of a stored table."""
    from tidemark.operators import governance as G
    from tidemark.plans import QUERIES

    plans, taken = [], G.fingerprint
    monkeypatch.setattr(G, "fingerprint", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or taken(df, *a))
    assert {r["second_run_reused"] for r in QUERIES["experiment_stages"](spark, "/root/testdata/sf0.001").collect()} == {True}
    assert len(plans) == 1 and "Window" not in plans[0]
