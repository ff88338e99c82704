"""Cross-fitting, boosters, proportional hazards, pinball loss, explanations and own pipeline stages, against plain numpy."""

from __future__ import annotations

import itertools
import math
import os
import random
from math import factorial

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.ml import cox, crossfit, explain, pinball
from tidemark.ml import models as M
from tidemark.ml import stages as S
from tidemark.operators import ranks, splits
from tidemark.plans import QUERIES

ROWS = "entity long, yr int, a double, b double, kind string, y double, w double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for e in range(240):
        for _ in range(2):
            a, b, kind = rng.uniform(0, 10), rng.choice([None, 1.0, 2.0]), rng.choice(["x", "y", None])
            out.append((e, 2010 + e // 48, a, b, kind, 3 * a + (20.0 if kind == "x" else 5.0) + rng.gauss(0, 1), 0.5))
    return spark.createDataFrame(out, ROWS).repartition(3)


FEATURES = M.Features(("a", "b"), ("kind",))


# Ranks


@pytest.mark.parametrize(("reuse", "partitions"), [("true", "16"), ("false", "16"), ("false", "200")])
def test_ranks_do_not_depend_on_the_plan(spark, reuse, partitions):
    """The same rows whether or not Spark reads one exchange twice, with few and many ranges."""
    rng = random.Random(2)
    data = [(rng.choice("ab"), float(rng.randrange(4000))) for _ in range(9000)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["g"]: r["m"] for r in ranks.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
        assert found == {g: float(np.median([v for h, v in data if h == g])) for g in "ab"}
        every = sorted(v for _, v in data)
        for r in ranks.average_percent_rank(df, "v", "rank").distinct().collect():
            first, n = every.index(r["v"]), every.count(r["v"])
            assert math.isclose(r["rank"], (first + 1 + (n - 1) / 2) / len(every))
        train, test = splits.by_rows(df.withColumn("i", F.monotonically_increasing_id()), ["v", "i"], 0.25)
        assert (train.count(), test.count()) == (6750, 2250)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_a_date_split_takes_the_kth_of_many_dates(spark):
    df = spark.sql("SELECT timestamp'2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 1000) AS d FROM range(5000)")
    train, test = splits.by_date(df, "d", 0.2)
    assert (train.count(), test.count()) == (4000, 1000)


# Cross-fitting


def test_no_fold_sees_its_own_entity(rows):
    """An entity with a wild label moves every prediction but its own fold's."""
    estimator = M.families("y", "w")["linear"]
    plain = {(r["entity"], r["a"]): (r["prediction"], r["fold"]) for r in crossfit.out_of_fold(rows, FEATURES, "entity", estimator, 3).collect()}
    assert len(plain) == 480 and {f for _, f in plain.values()} == {0, 1, 2}
    wild = rows.withColumn("y", F.when(F.col("entity") == 7, 1e6).otherwise(F.col("y")))
    other = {(r["entity"], r["a"]): (r["prediction"], r["fold"]) for r in crossfit.out_of_fold(wild, FEATURES, "entity", estimator, 3).collect()}
    own = next(f for (e, _), (_, f) in plain.items() if e == 7)
    for key, (p, fold) in plain.items():
        assert fold == other[key][1]
        assert math.isclose(p, other[key][0], rel_tol=1e-9) == (fold == own)
    assert all(len({f for (e, _), (_, f) in plain.items() if e == x}) == 1 for x in range(240))


def test_rolling_folds_see_earlier_years_only(rows):
    estimator = M.families("y", "w")["linear"]
    found = crossfit.rolling_out_of_fold(rows, FEATURES, "yr", "entity", estimator, 3)
    assert {(r["yr"], r["fold"]) for r in found.select("yr", "fold").distinct().collect()} == {(y, y) for y in (2012, 2013, 2014)}
    spoiled = rows.withColumn("y", F.when(F.col("yr") == 2014, 1e6).otherwise(F.col("y")))
    again = crossfit.rolling_out_of_fold(spoiled, FEATURES, "yr", "entity", estimator, 3)
    total = lambda df: df.agg(F.sum("prediction")).first()[0]
    assert math.isclose(total(found), total(again), rel_tol=1e-9)
    with pytest.raises(ValueError, match="two years"):
        crossfit.rolling_out_of_fold(rows.where("yr < 2012"), FEATURES, "yr", "entity", estimator, 3)


def test_out_of_fold_means_by_hand(spark):
    data = [(e, "g" if e % 2 else None, float(e), 1.0) for e in range(30)] + [(77, "alone", 5.0, 2.0), (8, None, None, 1.0)]
    df = spark.createDataFrame(data, "entity long, g string, y double, w double")
    got = crossfit.out_of_fold_means(df, ["g"], "entity", "y", "w", 4).collect()
    assert len(got) == len(data)
    for r in got:
        others = [x for x in got if x["fold"] != r["fold"] and x["y"] is not None]
        own = [x for x in others if x["g"] == r["g"]] or others
        want = sum(x["w"] * x["y"] for x in own) / sum(x["w"] for x in own)
        assert math.isclose(r["prediction"], want, rel_tol=1e-9)


def test_rows_stay_where_they_are_for_out_of_fold_means(spark):
    """The means are few; the table isn't sorted, or moved to a task a group and fold, to meet them."""
    df = spark.range(2000).select(F.col("id").alias("entity"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("y"), F.lit(1.0).alias("w"))
    plan = crossfit.out_of_fold_means(df, ["g"], "entity", "y", "w", 4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_the_bound_holds_the_booster(spark, rows):
    estimator = LinearRegression(featuresCol="features", labelCol="y", weightCol="w", predictionCol="prediction", regParam=0.1)
    bent = rows.withColumn("y", F.col("y") + F.when(F.col("a") > 8, 200.0).otherwise(0.0))
    found = crossfit.booster_gain(bent, FEATURES, "y", "w", "yr", "entity", estimator, folds=3, least=0.0).first()
    assert found["better"] and found["largest_correction"] <= found["cap"] + 1e-9 and found["rows"] == 96
    sizes = spark.createDataFrame([(-1.0, 1.0), (5.0, 1.0), (2.0, 8.0), (None, 9.0), (9.0, 0.0)], "r double, w double")
    assert crossfit.cap(sizes, "r", "w").first()["cap"] == 2.0
    assert crossfit.cap(sizes.limit(0), "r", "w").first()["cap"] == 1e-9


# Proportional hazards


def plain_cox(z, t, event, ridge, steps=50):
    """Efron's partial likelihood, row by row."""
    z, t, event = np.array(z, float), np.array(t, float), np.array(event, bool)
    n, d = z.shape
    sd = z.std(axis=0)
    sd[sd == 0] = 1
    z = (z - z.mean(axis=0)) / sd
    beta = np.zeros(d)
    for _ in range(steps):
        g, h = -n * ridge * beta, -n * ridge * np.eye(d)
        e = np.exp(z @ beta)
        for time in np.unique(t[event]):
            risk, tied = t >= time, (t == time) & event
            k = tied.sum()
            g = g + z[tied].sum(axis=0)
            for m in range(k):
                f = m / k
                s0 = e[risk].sum() - f * e[tied].sum()
                s1 = (e[risk, None] * z[risk]).sum(axis=0) - f * (e[tied, None] * z[tied]).sum(axis=0)
                s2 = np.einsum("i,ij,ik->jk", e[risk], z[risk], z[risk]) - f * np.einsum("i,ij,ik->jk", e[tied], z[tied], z[tied])
                g = g - s1 / s0
                h = h - (s2 / s0 - np.outer(s1, s1) / s0**2)
        step = np.linalg.solve(h, g)
        beta = beta - step
        if np.abs(step).max() < 1e-12:
            break
    e = np.exp(z @ beta)
    hazard, total = {}, 0.0
    for time in np.unique(t[event]):
        total += ((t == time) & event).sum() / e[t >= time].sum()
        hazard[float(time)] = total
    return beta / sd, hazard


@pytest.mark.parametrize("ridge", [0.2, 0.0])
def test_hazard_ratios_equal_a_plain_fit(spark, ridge, monkeypatch):
    """Ties (in chunks of seven), censored rows, rows that don't count."""
    monkeypatch.setattr(cox, "CHUNK", 7 if ridge else cox.CHUNK)
    rng = random.Random(5)
    data = []
    for _ in range(300):
        a, b = rng.gauss(0, 2), rng.choice([0.0, 1.0])
        data.append((a, b, float(min(12, 1 + int(rng.expovariate(0.2 * math.exp(0.4 * a - 0.7 * b))))), rng.random() < 0.8))
    df = spark.createDataFrame(data + [(1.0, 1.0, 0.0, True), (1.0, 1.0, None, True), (1.0, 1.0, 2.0, None)], "a double, b double, t double, e boolean").repartition(5)
    model = cox.fit(df, ["a", "b"], "t", "e", ridge=ridge)
    want, hazard = plain_cox([x[:2] for x in data], [x[2] for x in data], [x[3] for x in data], ridge)
    assert np.allclose(list(model.coefficients.values()), want, atol=1e-6)
    got = {r["t"]: r["hazard"] for r in model.tables["baseline"].collect()}
    assert got.keys() == hazard.keys() and all(math.isclose(got[k], hazard[k], rel_tol=1e-6) for k in hazard)
    held = model.finished_within(df, {"p0": 0.5, "p3": 3.0, "p99": 99.0}).collect()
    assert all(r["p0"] == 0 and 0 < r["p3"] < r["p99"] <= 1 for r in held)


def test_a_hazard_model_is_kept_whole(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), None if i % 5 == 0 else float(i % 3), float(1 + i % 9)) for i in range(90)], "a double, b double, t double")
    model = cox.fit(df, ["a", "b"], "t")
    model.write().save(f"file://{tmp_path}/cox")
    back = cox.CoxModel.load(f"file://{tmp_path}/cox")
    assert back.coefficients == model.coefficients and back.hazard_at([3.0, 0.0]) == model.hazard_at([3.0, 0.0])
    ratios = lambda m: sorted(r["log_hazard_ratio"] for r in m.transform(df).collect())
    assert ratios(back) == ratios(model)
    with pytest.raises(ValueError, match="no end"):
        cox.fit(df.withColumn("e", F.lit(False)), ["a"], "t", "e")


def test_concordance_counts_pairs(spark):
    rng = random.Random(6)
    data = [(float(rng.randrange(6)), float(rng.randrange(8))) for _ in range(200)]
    found = cox.concordance(spark.createDataFrame(data, "risk double, t double"), "risk", "t").first()
    right = sum(1 for a, b in itertools.product(data, data) if a[0] > b[0] and a[1] < b[1])
    wrong = sum(1 for a, b in itertools.product(data, data) if a[0] > b[0] and a[1] > b[1])
    assert (found["pairs"], round(found["concordance"], 12)) == (right + wrong, round(right / (right + wrong), 12))


def test_concordance_with_all_its_buckets(spark):
    """Risks that fill all 16 buckets: their sums once nested so deep that the driver ran out of memory."""
    rng = random.Random(7)
    data = [(float(i), float(rng.randrange(30))) for i in range(320)]
    found = cox.concordance(spark.createDataFrame(data, "risk double, t double"), "risk", "t").first()
    cuts = np.quantile([a for a, _ in data], [i / 16 for i in range(1, 16)])
    cut = [(int((a > cuts).sum()), t) for a, t in data]
    right = sum(1 for a, b in itertools.product(cut, cut) if a[0] > b[0] and a[1] < b[1])
    wrong = sum(1 for a, b in itertools.product(cut, cut) if a[0] > b[0] and a[1] > b[1])
    assert (found["pairs"], round(found["concordance"], 12)) == (right + wrong, round(right / (right + wrong), 12))


def test_concordance_of_all_pairs(spark, monkeypatch):
    """No pair is left out, whether its risks are near or one range or one duration holds many rows; in one range and in several."""
    rng = random.Random(8)
    near = [(i / 1000, float(rng.randrange(30))) for i in range(320)]
    ties = [(float(rng.randrange(3)), float(rng.randrange(200))) for _ in range(300)] + [(5.0, 7.0)] * 400
    spread = [(rng.gauss(0, 1), rng.expovariate(1)) for _ in range(500)]
    for rows in (near, ties, spread):
        right = sum(1 for a, b in itertools.product(rows, rows) if a[0] > b[0] and a[1] < b[1])
        wrong = sum(1 for a, b in itertools.product(rows, rows) if a[0] > b[0] and a[1] > b[1])
        df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "risk double, t double").repartition(5)
        for size in (250_000, 50, 1):
            monkeypatch.setattr(cox, "TASK_ROWS", size)
            found = cox.concordance(df, "risk", "t", buckets=None).first()
            assert found["pairs"] == right + wrong and math.isclose(found["concordance"], right / (right + wrong), rel_tol=1e-12)
    assert tuple(cox.concordance(df.limit(0), "risk", "t", buckets=None).first()) == (None, 0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_hazard_ratios_count_all_pairs(spark, monkeypatch):
    """The plan tells the concordance of all pairs of its rows, also of those whose risks are near."""
    seen, counted = [], cox.concordance
    monkeypatch.setattr(cox, "concordance", lambda df, *a, **k: seen.append(df) or counted(df, *a, **k))
    told = {r["concordance"] for r in QUERIES["hazard_ratios"](spark, "/root/testdata/sf0.001").collect()}
    a, t = (np.array(x) for x in zip(*seen[0].select("log_hazard_ratio", "days").collect(), strict=True))
    right, wrong = (sum(int(((a < a[i]) & far[i]).sum()) for i in range(len(a))) for far in (t > t[:, None], t < t[:, None]))
    assert told == {round(right / (right + wrong), 4)}


def test_many_ties_cost_no_more_than_few(spark):
    """Shares of tied events: the series against term by term, up to a risk set that ends whole, in a bounded number of terms."""
    ties = [(1, 1.0), (150, 0.5), (200, 1.0), (201, 1.0), (5_000, 1.0), (5_000, 0.3), (40_000, 1e-4), (40_000, 0.0)]
    df = spark.createDataFrame([(n, share / n) for n, share in ties], "n long, f double")
    for x in cox._efron(df).collect():
        left = 1 - np.arange(x["n"]) * x["f"]
        assert np.allclose([x["a1"], x["a2"], x["logs"]], [(1 / left).sum(), (1 / left**2).sum(), np.log(left).sum()], rtol=1e-9, atol=1e-12)
    big = spark.createDataFrame([(10**15, 1e-15)], "n long, f double")  # could not be summed one by one
    assert math.isclose(cox._efron(big).first()["logs"], -1e15, rel_tol=1e-9)


# Pinball loss


def test_lines_reach_the_least_loss(spark):
    """The best line of one feature passes through two points, so trying all pairs finds it."""
    rng = random.Random(7)
    data = [(x := rng.uniform(0, 10), 2 * x + rng.expovariate(0.2), rng.choice([0.5, 1.0, 2.0])) for _ in range(60)]
    df = spark.createDataFrame(data + [(3.0, None, 1.0), (3.0, 9.0, 0.0)], "x double, y double, w double")
    model = pinball.quantile_lines(df, M.Features(("x",)), "y", "w", (0.1, 0.5, 0.9), steps=60, tolerance=1e-9)
    for q in (0.1, 0.5, 0.9):
        loss = lambda a, b, q=q: sum(w * max(q * (y - a - b * x), (q - 1) * (y - a - b * x)) for x, y, w in data)
        least = min(loss(y1 - (y2 - y1) / (x2 - x1) * x1, (y2 - y1) / (x2 - x1)) for (x1, y1, _), (x2, y2, _) in itertools.combinations(data, 2) if x1 != x2)
        assert least - 1e-9 <= model.loss[q][-1] <= least * 1.005
        assert all(b <= a * (1 + 1e-6) for a, b in itertools.pairwise(model.loss[q]))  # no step makes it worse
    held = model.predict(df, {0.1: "low", 0.9: "high"})
    assert set(held.columns) == {"x", "y", "w", "low", "high"}
    error = held.agg(F.sum(F.col("w") * pinball.pinball("y", "low", 0.1))).first()[0]
    assert math.isclose(error, model.loss[0.1][-1], rel_tol=1e-9)


def test_rows_of_equal_features_are_packed_and_sum_alike(spark):
    rng = np.random.default_rng(3)
    x = np.array([[1.0, float(a), float(b)] for a, b in zip(rng.integers(0, 4, 3000), rng.integers(0, 3, 3000), strict=True)])
    y, w = rng.normal(size=3000) * 10, rng.choice([0.5, 1.0], 3000)
    df = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "x array<double>, y double, w double").repartition(3)
    packed = pinball._packed(df).cache()
    assert packed.count() <= 3 * 12 + 3000 // pinball.RUN_ROWS + 1  # runs: a task has each of 12 different features once, or in pieces
    assert pinball._shape(packed)[::2] == (3, 3000) and math.isclose(pinball._shape(packed)[1], np.abs(y).mean())
    beta = np.array([[1.0, 0.5, -0.5], [2.0, 0.0, 1.0]])
    left, right, loss = pinball._sums(packed, beta, [0.1, 0.9], 1e-3)
    for i, q in enumerate((0.1, 0.9)):
        r = y - x @ beta[i]
        v = w / (1e-3 + np.abs(r))
        assert np.allclose(left[i], x.T @ (x * v[:, None])) and np.allclose(right[i], x.T @ (v * y + (2 * q - 1) * w))
        assert math.isclose(loss[i], float(np.sum(w * np.maximum(q * r, (q - 1) * r))))
    apart = spark.createDataFrame([([1.0, float(i)], 1.0, 1.0) for i in range(500)], "x array<double>, y double, w double")
    assert pinball._packed(apart).count() == 500  # rows that all differ stay a run each


def test_tree_leaves_are_weighted_quantiles(spark):
    data = [(float(i % 2), float((i * 37) % 101 + 100 * (i % 2)), 1.0 + i % 3) for i in range(200)]
    df = spark.createDataFrame(data, "x double, y double, w double")
    model = pinball.quantile_trees(df, M.Features(("x",)), "y", "w", 0.3, rounds=1, depth=1, step=1.0, least_rows=1)
    found = {r["x"]: r["prediction"] for r in model.predict(df).select("x", "prediction").distinct().collect()}
    for x in (0.0, 1.0):
        own = sorted((y, w) for a, y, w in data if a == x)
        run, total = 0.0, sum(w for _, w in own)
        want = next(y for y, w in own if (run := run + w) >= 0.3 * total - 1e-12)
        assert math.isclose(found[x], want)


def test_more_rounds_lower_the_absolute_error(rows):
    error = lambda m: m.predict(rows).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    few, more = (error(pinball.quantile_trees(rows, FEATURES, "y", "w", 0.5, rounds=n, depth=3)) for n in (1, 5))
    assert more < 0.7 * few


def test_bands_are_ordered_and_widened_by_the_last_year(spark, rows):
    crossed = spark.createDataFrame([(5.0, 1.0, 3.0)], "p10 double, p50 double, p90 double")
    assert tuple(pinball.bands(crossed, "p10", "p50", "p90").first()) == (1.0, 3.0, 5.0)
    assert tuple(pinball.widened(pinball.bands(crossed, "p10", "p50", "p90"), 2.0, "p10", "p50", "p90").first()) == (-1.0, 3.0, 7.0)
    lines, told = pinball.calibrated_bands(rows, FEATURES, "y", "w", "yr")
    assert (told["year"], told["rows"]) == (2014, 96) and told["coverage"] >= 78
    _, wild = pinball.calibrated_bands(rows.withColumn("y", F.when(F.col("yr") == 2014, F.col("y") * 1.3).otherwise(F.col("y"))), FEATURES, "y", "w", "yr")
    assert wild["factor"] > told["factor"]


# Explanations


def conditional(node, x, known):
    """A tree's value when only some features are known: unknown splits go both ways, by training rows."""
    if "feature" not in node:
        return node["value"]
    if node["feature"] in known:
        kind, bound = node["test"]
        left = x[node["feature"]] <= bound if kind == "at most" else x[node["feature"]] in bound
        return conditional(node["left" if left else "right"], x, known)
    return sum(node[s]["cover"] / node["cover"] * conditional(node[s], x, known) for s in ("left", "right"))


def brute_shapley(trees, x):
    p, out = len(x), np.zeros(len(x))
    for j in range(p):
        rest = [k for k in range(p) if k != j]
        for size in range(p):
            for known in itertools.combinations(rest, size):
                gain = sum(w * (conditional(r, x, {*known, j}) - conditional(r, x, set(known))) for w, r in trees)
                out[j] += factorial(size) * factorial(p - 1 - size) / factorial(p) * gain
    return out


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_parts_are_shapley_values(spark, rows, kind):
    common = {"featuresCol": "features", "labelCol": "y", "predictionCol": "prediction", "seed": 3}
    estimator = {
        "tree": DecisionTreeRegressor(**common, maxDepth=4), "forest": RandomForestRegressor(**common, numTrees=4, maxDepth=3, weightCol="w"),
        "boosted": GBTRegressor(**common, maxIter=3, maxDepth=3),
    }[kind]
    model = M.fit(rows, FEATURES, estimator)
    trees = explain.tree_nodes(model.stages[-1])
    vectors = np.array([r["features"].toArray() for r in model.transform(M.prepared(rows, FEATURES)).select("features").limit(12).collect()])
    own = explain.shapley_values([(w, explain.leaves(r)) for w, r in trees], vectors)
    for x, got in zip(vectors, own, strict=True):
        assert np.allclose(got, brute_shapley(trees, x), atol=1e-9)
    parts, base, names = explain.explained(model, rows, FEATURES)
    assert set(names) == {"a", "b", "kind"}
    held = parts.select((F.lit(base) + sum((F.col(f"part_{n}") for n in names), F.lit(0.0)) - F.col("prediction")).alias("off")).agg(F.max(F.abs("off")), F.count("*")).first()
    assert held[0] < 1e-9 and held[1] == 480


def test_rows_that_no_tree_tells_apart_are_explained_once(monkeypatch):
    leaf = lambda v, c: {"value": v, "cover": c}
    inner = {"value": 0.0, "cover": 6.0, "feature": 1, "test": ("among", frozenset({1.0, 3.0})), "left": leaf(2.0, 2.0), "right": leaf(7.0, 4.0)}
    root = {"value": 0.0, "cover": 10.0, "feature": 0, "test": ("at most", 0.5), "left": leaf(1.0, 4.0), "right": inner}
    other = {"value": 0.0, "cover": 10.0, "feature": 0, "test": ("at most", 2.0), "left": leaf(-1.0, 5.0), "right": leaf(4.0, 5.0)}
    trees = [(0.5, explain.leaves(root)), (2.0, explain.leaves(other))]
    rng = np.random.default_rng(3)
    x = np.stack((rng.choice([0.0, 0.5, 0.6, 2.0, 2.1, np.nan], 500), rng.integers(0, 5, 500).astype(float)), 1)
    plain, seen, asked = explain.shapley_values(trees, x), [], explain.told_apart(trees)
    monkeypatch.setattr(explain, "shapley_values", lambda t, y, f=explain.shapley_values: seen.append(len(y)) or f(t, y))
    assert np.array_equal(explain.tree_parts(trees, asked, np.eye(2), x), plain)
    assert seen == [6]  # three ranges of one feature, in a set or not by the other
    assert explain.tree_parts(trees, asked, np.eye(2), x[:0]).shape == (0, 2)
    many = [(k % 2, "at most", np.arange(5.0) + k) for k in range(40)]  # more kinds than a number of 64 bits tells apart
    first, which = explain.kinds(many, y := np.floor(rng.uniform(0, 40, (300, 2))))
    assert np.array_equal(y[first][which], y)


def test_lines_are_explained_against_the_mean_row(rows):
    model = M.fit(rows, FEATURES, M.families("y", "w")["linear"])
    parts, base, names = explain.explained(model, rows, FEATURES, explain.vector_means(model, rows, FEATURES, "w"))
    found = parts.agg(F.avg("prediction"), *(F.avg(f"part_{n}") for n in names), F.max(F.abs(F.lit(base) + sum((F.col(f"part_{n}") for n in names), F.lit(0.0)) - F.col("prediction")))).first()
    assert math.isclose(found[0], base) and all(abs(x) < 1e-9 for x in found[1:-1]) and found[-1] < 1e-9


def test_the_largest_parts_of_a_row(spark):
    df = spark.createDataFrame([(1, 3.0, -5.0, 0.5, 0.5), (2, 0.0, 0.0, 0.0, 0.0)], "id int, part_a double, part_b double, part_c double, part_d double")
    one, none = explain.top_factors(df, ["a", "b", "c", "d"], 3).orderBy("id").collect()
    assert [(f["feature"], f["impact"], f["direction"]) for f in one["factors"]] == [("b", -5.0, "reduces"), ("a", 3.0, "increases"), ("c", 0.5, "increases")]
    assert math.isclose(sum(f["share"] for f in one["factors"]), 1.0) and math.isclose(one["rest"], 0.5)
    assert [f["feature"] for f in none["factors"]] == ["a", "b", "c"] and {f["share"] for f in none["factors"]} == {0.0}
    assert [r["feature"] for r in explain.global_parts(df, ["a", "b", "c", "d"]).collect()] == ["b", "a", "c", "d"]


def test_the_largest_parts_need_no_interpreted_lambdas(spark):
    df = spark.createDataFrame([(1, 3.0, -5.0)], "id int, part_a double, part_b double")
    top = explain.top_factors(df, ["a", "b"], 3)
    assert "lambda" not in top._jdf.queryExecution().optimizedPlan().toString()
    assert [(f["feature"], f["share"]) for f in top.first()["factors"]] == [("b", 0.625), ("a", 0.375)] and top.first()["rest"] == 0.0  # fewer than k


# Own stages


def test_calibration_falls_back_from_stage_to_bin_to_all(spark, tmp_path):
    rng = random.Random(8)
    data = [(rng.choice(["s", "t"]), p := rng.uniform(0, 100), p + (10 if p > 50 else -5) + rng.gauss(0, 1), 1.0) for _ in range(500)]
    oof = spark.createDataFrame(data, "stage string, prediction double, y double, w double")
    model = S.ShrunkCalibration("prediction", "stage", "y", "w", bins=4, strength=10.0, least=0.0).fit(oof)
    new = spark.createDataFrame([("s", 90.0), ("never seen", 90.0), ("s", 1.0), (None, 90.0), ("s", None)], "stage string, prediction double")
    table = {(r["stage"], r["bin"]): r["correction"] for r in model.tables["fine"].collect()}
    coarse = {r["bin"]: r["correction"] for r in model.tables["coarse"].collect()}
    edges = model.getOrDefault("edges")
    number = lambda x: sum(x >= e for e in edges)
    got = {(r["stage"], r["p"]): r["prediction"] for r in model.transform(new.withColumn("p", F.col("prediction"))).collect()}
    assert math.isclose(got["s", 90.0], 90 + table["s", number(90)]) and 97 < got["s", 90.0] < 101
    assert math.isclose(got["never seen", 90.0], 90 + coarse[number(90)]) and math.isclose(got[None, 90.0], got["never seen", 90.0])
    assert got["s", 1.0] == 0.0 and got["s", None] is None  # no less than ``least``; what isn't predicted isn't corrected
    assert table.keys() == {(s, b) for s in "st" for b in range(4)}


def test_priors_of_earlier_years_and_for_rows_to_come(spark):
    data = [(1, 2001, "a", "x", 10.0), (1, 2001, "a", "x", 10.0), (2, 2002, "a", "x", 20.0), (3, 2002, "a", "y", 60.0), (4, 2003, None, "x", 0.0), (5, None, "a", "x", 99.0), (6, 2004, "b", "z", None)]
    df = spark.createDataFrame(data, "entity long, yr int, k string, s string, y double")
    prior = S.HierarchicalPrior([["k", "s"], ["k"]], "y", "entity", "yr", strength=0.0)
    got = {(r["entity"], r["s"]): (r["prior"], r["prior_support"]) for r in prior.earlier(df).collect()}
    assert got[1, "x"] == (0.0, 0) and got[2, "x"] == (10.0, 1) and got[3, "y"] == (10.0, 1)
    assert got[4, "x"] == (30.0, 0) and got[5, "x"] == (0.0, 0) and got[6, "z"] == (22.5, 0)
    assert prior.earlier(df).count() == len(data)
    later = {(r["k"], r["s"]): (r["prior"], r["prior_support"]) for r in prior.fit(df).transform(df.select("k", "s").distinct()).collect()}
    assert later["a", "x"] == (43.0, 3) and later["a", "y"] == (60.0, 1) and later[None, "x"] == (0.0, 1) and later["b", "z"] == (37.8, 0)
    shrunk = S.HierarchicalPrior([["k", "s"], ["k"]], "y", "entity", "yr", strength=5.0)
    later = {(r["k"], r["s"]): r["prior"] for r in shrunk.fit(df).transform(df.select("k", "s").distinct()).collect()}
    assert math.isclose(later["a", "y"], (60 + 5 * 37.8) / 6)
    assert math.isclose(next(r["prior"] for r in shrunk.earlier(df).collect() if r["entity"] == 4), 30.0)


def test_stages_are_kept_inside_a_pipeline(spark, rows, tmp_path):
    """Prepared rows, a prior, a line, a calibration and a gate, saved and read back, say the same."""
    prior = S.HierarchicalPrior([["kind"]], "y", "entity", "yr").fit(rows)
    enriched = prior.transform(rows)
    own = M.Features(("a", "prior"), ("kind",))
    base = M.fit(enriched, own, M.families("y", "w")["linear"])
    held = M.predict(base, enriched, own).withColumn("stage", F.col("kind"))
    calibration = S.ShrunkCalibration("prediction", "kind", "y", "w", least=0.0).fit(held)
    made = ["features", "kind_index", "kind_hot", "a_filled", "prior_filled", "a_missing", "prior_missing"]
    gate = S.Derived("prediction", "CASE WHEN coalesce(gate, true) THEN prediction ELSE prior END", ["gate"])
    whole = PipelineModel([prior, S.Prepared(["a", "prior"], ["kind"]), *base.stages, S.Dropped(made), calibration, gate])
    whole.write().save(f"file://{tmp_path}/whole")
    back = PipelineModel.load(f"file://{tmp_path}/whole")
    read = lambda m, df: sorted((r["entity"], r["a"], r["prediction"]) for r in m.transform(df).collect())
    assert read(whole, rows) == read(back, rows) and len(read(back, rows)) == 480
    closed = back.transform(rows.withColumn("gate", F.lit(False))).select(F.max(F.abs(F.col("prediction") - F.col("prior")))).first()[0]
    assert closed == 0


def test_rows_of_a_forest_are_dealt_over_tasks_of_bounded_size(spark, rows, monkeypatch, tmp_path):
    """However few partitions the rows come in; the model stays a pipeline that is kept whole."""
    monkeypatch.setattr(M, "TASK_ROWS", 50)
    seen = []
    real = RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df: seen.append(df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()) or real(self, df))
    features = M.Features(("a", "b"), ("kind",))
    model = M.fit(rows.coalesce(1), features, RandomForestRegressor(labelCol="y", weightCol="w", numTrees=2, maxDepth=2, seed=7))
    counts = [r["count"] for r in seen[0]]
    assert sum(counts) == rows.count() and max(counts) <= 60
    model.write().save(f"file://{tmp_path}/forest")
    told = lambda m: sorted(r["prediction"] for r in M.predict(m, rows, features).collect())
    assert told(PipelineModel.load(f"file://{tmp_path}/forest")) == told(model)


# Packed rows


@pytest.fixture(scope="module")
def repeated(spark):
    """Many rows of few different features, one of them missing at times."""
    rng = random.Random(11)
    out = []
    for i in range(4000):
        a, b, kind = float(rng.randrange(6)), rng.choice([None, 1.0, 2.0]), rng.choice(["x", "y", "y"])
        out.append((i, 2010 + i % 4, a, b, kind, 10 * a * a + (30.0 if kind == "x" else 5.0) + 9 * (b or 0) + rng.gauss(0, 5), rng.choice([0.0, 0.5, 1.0])))
    return spark.createDataFrame(out, ROWS).repartition(3)


def fitted_plainly(rows, estimator):
    """Without packing, as pyspark.ml fits it on the rows."""
    return PipelineModel([*(before := M.Pipeline(stages=M.stages(FEATURES)).fit(M.prepared(rows, FEATURES))).stages, estimator.fit(before.transform(M.prepared(rows, FEATURES)))])


def test_packed_rows_give_the_same_lines_and_trees(spark, repeated, rows):
    families = M.families("y", "w")
    packs = M.packed(M.prepared(repeated, FEATURES), FEATURES, "y", "w")
    assert packs.count() <= 2 * 36 and M.packed(M.prepared(rows, FEATURES), FEATURES, "y", "w") is None
    line, plain = M.fit(repeated, FEATURES, families["linear"]).stages[-1], fitted_plainly(repeated, families["linear"]).stages[-1]
    assert np.allclose([*line.coefficients, line.intercept], [*plain.coefficients, plain.intercept], rtol=1e-9, atol=1e-9)
    said = lambda model: np.array([r[0] for r in M.predict(model, repeated, FEATURES).orderBy("entity").select("prediction").collect()])
    assert np.allclose(said(M.fit(repeated, FEATURES, families["boosted"])), said(fitted_plainly(repeated, families["boosted"])), rtol=1e-9)
    part = M.Training(repeated, FEATURES, [families["linear"]], ("yr",)).where(F.col("yr") < 2012).fit(families["linear"]).stages[-1]
    other = fitted_plainly(repeated.where("yr < 2012"), families["linear"]).stages[-1]
    assert np.allclose([*part.coefficients, part.intercept], [*other.coefficients, other.intercept], rtol=1e-9, atol=1e-9)
    with pytest.raises(Exception, match="(?i)label"):
        M.fit(repeated.withColumn("y", F.when(F.col("entity") > 7, F.col("y"))), FEATURES, families["linear"])


def test_trees_fitted_apart_are_those_of_what_they_draw(spark, repeated):
    """Draws are by row; a booster's leaves hold their least number of rows, in a round that needs counting and in one that doesn't."""
    rows = M.prepared(repeated, FEATURES)
    found = M._drawn(rows, FEATURES, "y", "w", 40, 7, None).collect()
    whole = {r["m"]: (r["n"], r["w"]) for r in rows.groupBy(M._mark(FEATURES).alias("m")).agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    assert {r["_mark"] for r in found} == whole.keys()
    n = np.array([[r[f"n{i}"] - whole[r["_mark"]][0] for i in range(40)] for r in found])
    expected = sum(x for x, _ in whole.values())
    assert abs(n.sum()) < 5 * math.sqrt(40 * expected) and 0.7 < (n**2).mean(axis=1).sum() / expected < 1.3  # Poisson, row by row
    half = M._drawn(rows, FEATURES, "y", None, 5, 7, 1.0).collect()
    assert all(r["n3"] == r["w3"] == whole[r["_mark"]][0] for r in half)
    forest = M.families("y", "w")["forest"]
    apart, plain = M.Training(repeated, FEATURES, [forest], apart=True).fit(forest), fitted_plainly(repeated, forest)
    said = lambda model: np.array([r[0] for r in M.predict(model, repeated, FEATURES).orderBy("entity").select("prediction").collect()])
    far = np.abs(said(apart) - said(plain))
    assert far.mean() < 6 < said(plain).std() and set(M.predict(apart, repeated, FEATURES).columns) == set(M.predict(plain, repeated, FEATURES).columns)
    assert M.importance(apart, FEATURES, repeated)[0][0] == M.importance(plain, FEATURES, repeated)[0][0] == "a"
    for least in (80, 900):
        whole = GBTRegressor(featuresCol="features", labelCol="y", weightCol="w", maxIter=6, stepSize=0.1, maxDepth=3, minInstancesPerNode=least, subsamplingRate=1.0, seed=7)
        rounds = M.Training(repeated.where("w > 0"), FEATURES, [whole], apart=True).fit(whole)
        assert np.allclose(said(rounds), said(fitted_plainly(repeated.where("w > 0"), whole)), rtol=1e-9)
