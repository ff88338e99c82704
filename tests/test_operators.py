"""Hand-computed cases of the operators."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import aggregates as A
from tidemark.operators import audits, joins, ranks, splits
from tidemark.operators import windows as W
from tidemark.sources.schemas import SNAPSHOT, columns, fit_contract


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def unit(spark):
    return spark.range(1)


def day(y, m, d):
    return F.lit(f"{y}-{m:02d}-{d:02d}").cast("date")


def test_measures_of_a_snapshot(unit):
    # A work of 64 sanctioned, 72 expected, 16 spent; 200 days planned from 1 March 2021, moved by 45; 25 % built on day 150.
    start, end, moved, now = day(2021, 3, 1), day(2021, 9, 17), day(2021, 11, 1), day(2021, 7, 29)
    assert one(unit, X.ratio(F.lit(16.0), F.lit(64.0))) == 0.25
    assert one(unit, X.pct_change(F.lit(64.0), F.lit(72.0))) == 12.5
    assert (one(unit, X.days(end, start)), one(unit, X.days(moved, end)), one(unit, X.days(now, start))) == (200, 45, 150)
    expected = X.clamp(X.ratio(X.days(now, start), X.days(end, start)) * 100, 0.0, 100.0)
    assert one(unit, F.lit(25.0) - expected) == -50
    late = X.clamp(X.ratio(X.days(moved, start), X.days(end, start)) * 100, 0.0, 100.0)
    assert one(unit, F.lit(25.0) - late) == -75


def test_missing_stays_missing(unit):
    null = F.lit(None).cast("double")
    for column in (X.ratio(null, F.lit(1.0)), X.pct_change(F.lit(0.0), F.lit(1.0)), X.clamp(null, 0.0, 1.0), X.delay_days(F.lit(None).cast("date"), day(2020, 1, 1)), X.log1p_positive(F.lit(-1.0)), X.finite(F.lit(math.inf)), X.number(F.lit("N.A.")), X.number(F.lit("x1"))):
        assert one(unit, column) is None
    assert one(unit, X.number(F.lit(" (1,234.50) "))) == 1234.5
    assert one(unit, X.available(null, "double")) is False


@pytest.mark.parametrize(("x", "label"), [(500, "small"), (500.01, "medium"), (2000, "medium"), (10000, "large"), (10000.5, "mega"), (None, None)])
def test_right_closed_sizes(unit, x, label):
    assert one(unit, X.band(F.lit(x).cast("double"), X.SIZE4)) == label


@pytest.mark.parametrize(("d", "label", "code"), [(0, "LOW", 0), (89, "LOW", 0), (90, "MEDIUM", 1), (365, "HIGH", 2), (730, "CRITICAL", 3), (None, None, 3)])
def test_left_closed_risks(unit, d, label, code):
    assert one(unit, X.risk_label(F.lit(d).cast("int"))) == label
    assert one(unit, X.risk_code(F.lit(d).cast("int"))) == code


def test_calendar(unit):
    assert one(unit, X.fiscal_year(day(2020, 3, 31))) == "2019-20"
    assert one(unit, X.fiscal_year(day(1999, 4, 1))) == "1999-00"
    assert one(unit, X.fiscal_month_end(F.lit("2019-20"), F.lit(2))) == dt.date(2020, 2, 29)
    assert one(unit, X.fiscal_month_end(F.lit("2019-20"), F.lit(4))) == dt.date(2019, 4, 30)
    assert one(unit, X.month_gap(day(2020, 3, 1), day(2020, 3, 31))) is None
    assert one(unit, X.quarter_label(day(2020, 12, 1))) == "2020Q4"


def test_keys_and_labels(unit):
    assert one(unit, X.name_key(F.lit("  Outer MOLE -- (East) 7"))) == "outer mole east 7"
    assert one(unit, X.name_key(F.lit("--"))) is None
    assert one(unit, X.fallback_key(F.lit("A1"), F.lit("x"), F.lit("y"))) == "A1"
    assert one(unit, X.fallback_key(F.lit(None).cast("string"), F.lit("X!"), F.lit("y"))).startswith("legacy:")
    assert one(unit, X.run_key(F.lit("monthly-1997-2006"))) == "1997_2006"
    assert one(unit, X.part_number(F.lit("June (Part II)"))) == 2
    assert one(unit, X.part_number(F.lit("June part-3"))) == 3
    assert one(unit, X.part_number(F.lit("June"))) is None
    assert one(unit, X.amount_label(F.lit(1500.0))) == "1.5 k"
    assert one(unit, X.span_label(F.lit(730))) == "2.0 years"


def test_improvement_of_zero_baselines(unit):
    assert one(unit, X.improvement_pct(F.lit(0.0), F.lit(0.0))) == 0
    assert one(unit, X.improvement_pct(F.lit(0.0), F.lit(1.0))) is None
    assert one(unit, X.improvement_pct(F.lit(4.0), F.lit(3.0))) == 25


def history(spark, rows):
    return spark.createDataFrame(rows, "k string, day int, v double")


ROWS = [("A", 0, 10.0), ("A", 31, None), ("A", 61, 13.0), ("A", 92, 16.0), ("A", 400, 16.0), ("B", 5, None), ("B", 6, 1.0)]
OPERATORS = {
    "slope": lambda: W.slope("v", "k", 93),
    "sum": lambda: W.trailing_sum("v", "k", 93),
    "count": lambda: W.trailing_count(F.col("v").isNotNull().cast("int"), "k", 93),
    "std": lambda: W.trailing_std("v", "k", 93),
    "depth": lambda: W.depth("k", 366),
    "since": lambda: W.months_since((F.col("v") > 12).cast("int"), "k"),
    "first": lambda: W.months_since_first((F.col("v") > 12).cast("int"), "k"),
    "revised": lambda: W.revised("v", "k"),
    "trend": lambda: W.two_point_trend("v", "k", 183),
    "mean": lambda: W.running_mean("v", "k"),
    "peak": lambda: W.running_max("v", "k"),
    "worse": lambda: W.worsened("v", "k"),
    "known": lambda: W.change_from_known("v", "k"),
    "accel": lambda: W.acceleration("v", "k", 93, 186),
}


def measured(spark, rows):
    df = history(spark, rows).select("k", "day", *(f().alias(n) for n, f in OPERATORS.items()))
    return {(r["k"], r["day"]): r.asDict() for r in df.collect()}


def test_hand_computed_windows(spark):
    got = measured(spark, ROWS)
    assert got["A", 0]["slope"] is None and got["A", 31]["slope"] is None
    assert got["A", 61]["slope"] == pytest.approx(3 / (61 / W.MONTH_DAYS))
    assert got["A", 92]["slope"] == pytest.approx(6 / (92 / W.MONTH_DAYS))
    assert got["A", 400]["slope"] is None
    assert got["A", 92]["sum"] == 39 and got["A", 400]["sum"] == 16
    assert got["A", 92]["std"] == pytest.approx(3.0)
    assert got["A", 92]["depth"] == 4 and got["A", 400]["depth"] == 3
    assert got["A", 31]["since"] is None and got["A", 61]["since"] == 0
    assert got["A", 31]["first"] is None and got["A", 92]["first"] == pytest.approx(31 / W.MONTH_DAYS)
    assert [got["A", d]["revised"] for d in (0, 31, 61, 92, 400)] == [0, 0, 1, 1, 0]
    assert got["A", 31]["peak"] is None and got["A", 61]["peak"] == 13
    assert got["A", 0]["worse"] is None and got["A", 31]["worse"] == 0 and got["A", 92]["worse"] == 1
    assert got["A", 61]["known"] == 3


@pytest.mark.parametrize("later", [("A", 93, 9999.0), ("B", 7, 9999.0), ("A", 401, None)])
def test_later_rows_change_nothing(spark, later):
    cut = [r for r in ROWS if r[0] != later[0] or r[1] < later[1]]
    before, after = measured(spark, cut), measured(spark, [*cut, later])
    assert all(after[key] == value for key, value in before.items())


def test_streak(spark):
    rows = [("A", i, v) for i, v in enumerate([1.0, 2.0, None, 2.5, 3.0, 3.0, 4.0])]
    got = W.streak(history(spark, rows), "v", "k", "s").orderBy("day").collect()
    assert [r["s"] for r in got] == [0, 1, 1, 1, 2, 0, 1]


def test_average_percent_rank_in_both_forms(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 5.0), (4, None), (5, 9.0)], "i int, v double")
    want = {1: 2.5 / 4, 2: 1 / 4, 3: 2.5 / 4, 4: None, 5: 1.0}
    assert {r["i"]: r["x"] for r in ranks.average_percent_rank(df, "v", "x").collect()} == want
    assert {r["i"]: r["x"] for r in df.select("i", W.average_percent_rank("v").alias("x")).collect()} == want


def test_weights_sum_to_one_and_follow_filters(spark):
    df = spark.createDataFrame([("A", 1000.0, 1), ("A", 10.0, 2), ("B", 20.0, 2), ("B", 20.0, 3)], "k string, y double, depth int")
    kept = df.where("depth >= 2").withColumn("w", W.balanced_weight("k"))
    assert kept.agg((F.sum(F.col("w") * F.abs("y")) / F.sum("w")).alias("mae")).first()["mae"] == 15.0
    assert {r["s"] for r in df.withColumn("w", W.balanced_weight("k")).groupBy("k").agg(F.sum("w").alias("s")).collect()} == {1.0}


def test_identity_methods(spark):
    rows = spark.createDataFrame([("1", "alpha", 5.0), (None, "beta", 10.02), (None, "beta", 11.0), (None, "twice", 1.0), ("9", "none", 1.0), (None, None, None)], "entity_id string, name_key string, amount double")
    outcomes = spark.createDataFrame([("1", "x", 1.0), ("2", "beta", 10.0), ("3", "twice", 1.0), ("4", "twice", 1.0)], "outcome_id string, outcome_key string, outcome_amount double")
    got = joins.resolve_identity(rows, outcomes).collect()
    methods = sorted((r["method"], r["verified"], r["outcome_id"] or "") for r in got)
    assert methods == [("ambiguous_name", False, ""), ("exact_id", True, "1"), ("exact_name_and_amount", True, "2"), ("name_amount_mismatch", False, ""), ("unresolved", False, ""), ("unresolved", False, "")]


def test_earlier_means_strictly(spark):
    facts = spark.createDataFrame([("g", 1, 10.0), ("g", 2, 20.0), ("g", 2, 30.0), ("h", 1, 99.0)], "s string, day int, y double")
    asked = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("z", 9), ("g", None), (None, 5)], "s string, day int")
    got = {(r["s"], r["day"]): (r["p_n"], r["p_m"]) for r in joins.earlier_stats(asked, facts, "day", {"m": F.col("y")}, ("s",), "p").collect()}
    assert got == {("g", 1): (0, None), ("g", 2): (1, 10.0), ("g", 3): (3, 20.0), ("z", 9): (0, None), ("g", None): (None, None), (None, 5): (0, None)}


def test_a_doubled_key_on_the_right_is_an_error(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        joins.many_to_one(left, right, ["k"]).collect()


def test_peers_fall_back_to_all_rows(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "a", 11.0), (3, "a", 100.0), (4, "lonely", 12.0)], "i int, s string, y double")
    got = {(r["focus_id"], r["i"]) for r in joins.peers(df, df.where("i in (1, 4)"), "s", "i", "y", 2).collect()}
    assert got == {(1, 2), (1, 3), (4, 2), (4, 1)}


def test_peers_of_every_row_equal_brute_force_whatever_their_number(spark):
    import math

    rows = [(i, None if i % 997 == 0 else f"g{i % 2}" if i % 3 else f"lone{i}" if i < 60 else "g0", float(i * 7919 % 3001)) for i in range(10_500)]
    df = spark.createDataFrame(rows, "i int, s string, y double").repartition(5)
    got = {}
    for r in joins.peers(df, df, "s", "i", "y", 3).collect():
        got.setdefault(r["focus_id"], []).append((r["place"], r["i"]))
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for i, s, y in [*rows[:120], *rows[::499], *sorted(rows, key=lambda r: r[2])[:20], *sorted(rows, key=lambda r: r[2])[-20:]]:
        own = groups[s] if s is not None and len(groups[s]) > 1 else rows
        near = sorted((abs(math.log1p(b) - math.log1p(y)), j) for j, _, b in own if j != i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near], (i, s, y)


def test_neighbours_of_an_amount_are_as_many_as_are_asked_for(spark):
    """Not a set for each row that grows with ties on both sides: what is sorted and shuffled afterwards is k rows a focus."""
    df = spark.createDataFrame([(i, "a", float(i // 20)) for i in range(400)], "i int, s string, y double")
    assert {len(r["_near"]) for r in joins._around(df, ("s",), "i", "y", 3).collect()} == {4}
    found = joins.peers(df, df, "s", "i", "y", 3)
    assert found.count() == 1200 and "Window" not in found._jdf.queryExecution().executedPlan().toString().split("Generate")[0]


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 8.0), ("b", 5.0, 0.0), ("b", 7.0, 0.0), ("a", None, 9.0)], "g string, x double, w double")
    assert {r["g"]: r["value"] for r in A.weighted_quantile(df, "x", "w", 0.5, ["g"]).collect()} == {"a": 3.0, "b": 6.0}
    assert A.weighted_quantile(df, "x", "w", 0.1).first()["value"] == 1.0


def test_metrics_of_a_perfect_and_an_empty_prediction(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (None, 3.0)], "y double, p double")
    m = df.agg(*(v.alias(k) for k, v in A.regression_metrics("y", "p").items())).first()
    assert (m["mae"], m["rmse"], m["r2"], m["rows"]) == (0, 0, 1, 2)
    none = df.where("y > 5").agg(*(v.alias(k) for k, v in A.regression_metrics("y", "p").items())).first()
    assert none["mae"] is None and none["rows"] == 0


def test_skewness_is_bias_corrected(spark):
    x = [1.0, 2.0, 2.0, 9.0]
    mean = sum(x) / 4
    m2, m3 = (sum((v - mean) ** k for v in x) / 4 for k in (2, 3))
    want = m3 / m2**1.5 * math.sqrt(4 * 3) / 2
    assert spark.createDataFrame([(v,) for v in x], "x double").agg(A.skewness("x")).first()[0] == pytest.approx(want)


def test_bootstrap_repeats_itself(spark):
    df = spark.createDataFrame([(i, 10.0, 9.0 + i % 3) for i in range(60)], "e int, a double, b double")
    first, second = (A.paired_bootstrap(df, "e", "a", "b", 100).first() for _ in range(2))
    assert first == second and first["low"] <= first["mean_gain"] <= first["high"] and first["draws"] == 100


def test_parts_and_conflicts(spark):
    df = spark.createDataFrame([("N1", 1, 500.0, None, "one"), ("N1", 2, 510.0, 40.0, "two"), (None, 3, 1.0, None, "x")], "id string, n int, cost double, progress double, source string")
    merged = {r["id"]: r for r in audits.coalesced_parts(df, "id", "n", ["cost", "progress"], "source").collect()}
    assert (merged["N1"]["cost"], merged["N1"]["progress"], merged["N1"]["source"]) == (510.0, 40.0, "one | two")
    assert merged[None]["cost"] == 1.0
    assert [(r["field"], r["values"]) for r in audits.conflicts(df, ["id"], ["cost", "progress"]).collect()] == [("cost", "500.0 | 510.0")]


def test_temporal_split(spark):
    df = spark.createDataFrame([(dt.date(2020, m, 28),) for m in range(1, 6)], "d date")
    train, test = splits.by_date(df, "d", 0.4)
    assert train.agg(F.max("d")).first()[0] < test.agg(F.min("d")).first()[0]
    with pytest.raises(ValueError):
        splits.by_date(df.limit(1), "d", 0.4)


def test_contract_fills_and_orders_columns(spark):
    df = fit_contract(spark.createDataFrame([("1.5",)], "approved_cost_cr string"), columns(SNAPSHOT))
    assert df.columns[0] == "project_id" and len(df.columns) == 25
    assert df.first()["approved_cost_cr"] == 1.5


def test_features_must_not_tell_the_outcome():
    with pytest.raises(ValueError, match="final"):
        audits.require_disjoint(["a", "final"], ["final"])


def test_quantiles_of_groups_equal_plain_ones_over_many_partitions(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(None if i % 50 == 0 else "abc"[i % 3], None if i % 17 == 0 else float(v)) for i, v in enumerate(rng.integers(0, 40, 900))] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    qs = {"low": 0.03, "mid": 0.5, "high": 0.9}
    for by, groups in ((["g"], {None, "a", "b", "c"}), ([], {()})):
        found = {r["g"] if by else (): r for r in ranks.quantiles(df, "x", qs, by).collect()}
        assert set(found) == groups
        for g, r in found.items():
            own = [x for k, x in rows if x is not None and (not by or k == g)]
            assert [r[n] for n in qs] == pytest.approx([np.quantile(own, q) for q in qs.values()])
    assert ranks.quantiles(df.limit(0), "x", qs).collect() == [(None, None, None)]
    assert ranks.quantiles(df.limit(0), "x", qs, ["g"]).count() == 0
    by_group = {r["i"]: r["p"] for r in ranks.average_percent_rank(spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "b", 1.0), (4, None, 2.0), (5, "a", None)], "i int, g string, x double"), "x", "p", ["g"]).collect()}
    assert by_group == {1: 0.75, 2: 0.75, 3: 1.0, 4: 1.0, 5: None}


def test_no_plan_of_quantiles_gathers_values(spark):
    df = spark.createDataFrame([(1.0, 1.0, "s")], "x double, w double, s string")
    for out in (A.distribution(df, "x"), A.weighted_quantile(df, "x", "w", 0.5, ["s"]), A.calibrated(df, "x", "x", "s", "w"), A.robust_weight(df, "x")):
        assert "percentile" not in out._jdf.queryExecution().toString().lower()
