"""Composed models in bundles, guarded promotion, retraining in one call, comparison over bundles."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidemark.ml import bundles as B
from tidemark.ml import crossfit, experiments, promoted, retrain
from tidemark.ml import models as M
from tidemark.operators import versions
from tidemark.operators import windows as W


@pytest.fixture(scope="module")
def rows(spark):
    """Works of six years, two snapshots each; delays depend on a, the office and the year's luck; some have no planned day."""
    rng, out = random.Random(11), []
    for e in range(180):
        a, office, year = rng.uniform(1, 10), rng.choice("pqr"), 2010 + e // 30
        delay = 60 + 30 * a + {"p": 0, "q": 120, "r": 240}[office] + rng.gauss(0, 10)
        for k in range(2):
            snapshot = date(year - 1, 1, 1) + timedelta(days=180 * k)
            planned = date(year, 1, 1) if e % 9 else None
            out.append((e, year, snapshot, planned, a, office, "early" if k == 0 else "late", delay, 5 * a + rng.gauss(0, 0.2), int(delay > 300) + int(delay > 420)))
    schema = "canonical_id long, completion_year int, snapshot date, planned date, a double, office string, stage string, final_delay_days double, final_cost_overrun_pct double, risk int"
    return spark.createDataFrame(out, schema).withColumn("weight", W.balanced_weight("canonical_id"))


FEATURES = M.Features(("a",), ("stage",))


@pytest.fixture(scope="module")
def delay(rows):
    return promoted.delay_model(rows.where("completion_year < 2015"), FEATURES, "final_delay_days", "weight", "completion_year", "canonical_id", "stage", "snapshot", "planned", [["office"]])


def test_a_fit_stores_only_what_it_reads(rows, monkeypatch):
    kept, own = [], promoted.stored
    monkeypatch.setattr(promoted, "stored", lambda df, name: kept.append(df.columns) or own(df, name))
    promoted.DelayParts(rows, FEATURES, "final_delay_days", "weight", "snapshot", "planned")
    assert kept == [["features", "final_delay_days", "weight", "snapshot", "planned"]]


def test_a_composed_model_is_kept_in_a_bundle_and_says_the_same(spark, rows, delay, tmp_path):
    path = f"file://{tmp_path}/bundle"
    B.save(spark, {"delay": delay}, {}, path, "run1", "data1", ["a", "stage"])
    back = B.load(spark, path)[0]["delay"]
    late = rows.where("completion_year = 2015")
    read = lambda m: sorted((r["canonical_id"], r["stage"], round(r["prediction"], 9)) for r in m.transform(late).collect())
    assert read(back) == read(delay) and len(read(back)) == 60
    assert set(delay.transform(late).columns) == {*rows.columns, "prediction"}


def test_the_gate_and_the_dates_choose_the_part(spark, rows, delay):
    late = rows.where("completion_year = 2015")
    free, shut = delay.transform(late), delay.transform(late.withColumn(promoted.GATE, F.lit(False)))
    said = {(r["canonical_id"], r["stage"]): (r["prediction"], r["planned"]) for r in free.collect()}
    for r in shut.collect():
        p, planned = said[r["canonical_id"], r["stage"]]
        assert (p == r["prediction"]) == (planned is None)
        assert r["prediction"] >= 0 and p >= 0
    null = delay.transform(late.withColumn(promoted.GATE, F.lit(None).cast("boolean"))).agg(F.sum("prediction")).first()[0]
    assert math.isclose(null, sum(p for p, _ in said.values()))
    error = free.agg(F.avg(F.abs(F.col("prediction") - F.col("final_delay_days")))).first()[0]
    mean = rows.where("completion_year < 2015").agg(F.avg("final_delay_days")).first()[0]
    plain = late.agg(F.avg(F.abs(F.col("final_delay_days") - mean))).first()[0]
    assert error < 0.75 * plain


def test_corrections_need_two_years(rows):
    with pytest.raises(ValueError, match="two years"):
        promoted.delay_model(rows.where("completion_year < 2012"), FEATURES, "final_delay_days", "weight", "completion_year", "canonical_id", "stage", "snapshot", "planned", [["office"]])


def test_the_gate_takes_the_entities_of_most_evidence(spark):
    df = spark.createDataFrame([(1, 1.0, None, 9.0), (1, 1.0, 1.0, 9.0), (2, 1.0, 1.0, 0.0), (3, None, None, 1.0), (4, 1.0, 1.0, 5.0), (4, 1.0, 1.0, 5.0), (None, None, 1.0, 2.0)], "e long, a double, b double, outcome double")
    found = {r["e"]: r[promoted.GATE] for r in promoted.evidence_gate(df, "e", ["a", "b"], 3).collect()}
    assert found == {4: True, 2: True, 1: True, 3: False, None: False}
    other = {r["e"]: r[promoted.GATE] for r in promoted.evidence_gate(df.withColumn("outcome", -F.col("outcome")), "e", ["a", "b"], 3).collect()}
    assert other == found


def test_promotion_changes_one_model_and_only_for_a_gain(spark, rows, delay, tmp_path):
    path = f"file://{tmp_path}/it's a bundle"
    early, late = rows.where("completion_year < 2015"), rows.where("completion_year = 2015")
    base = M.fit(early, FEATURES, M.families("final_delay_days", "weight")["linear"])
    cost = M.fit(early, FEATURES, M.families("final_cost_overrun_pct", "weight")["linear"])
    first = B.save(spark, {"delay": base, "cost": cost}, {"metrics": {}}, path, "run1", "data1", ["a", "stage"])
    held = M.predict(base, late, FEATURES, "current").drop("a_missing")
    held = delay.transform(held).withColumnRenamed("prediction", "challenger")
    with pytest.raises(ValueError, match="cohort has 60"):
        promoted.promote(spark, path, "delay", delay, held, "final_delay_days", "weight", "run2", "current", "challenger", expected_rows=688)
    with pytest.raises(ValueError, match="suffice"):
        promoted.promote(spark, path, "delay", delay, held, "final_delay_days", "weight", "run2", "challenger", "current")
    assert B.check(spark, path)[1] == first
    done = promoted.promote(spark, path, "delay", delay, held, "final_delay_days", "weight", "run2", "current", "challenger", expected_rows=60)
    metadata, manifest = B.check(spark, path, ("delay", "cost"))
    assert done["models"]["cost"] == first["models"]["cost"] and done["models"]["delay"] != first["models"]["delay"]
    assert (manifest["run"], manifest["previous_run"], metadata["promotions"][0]["model"]) == ("run2", "run1", "delay")
    loaded = B.load(spark, path)[0]["delay"]
    assert isinstance(loaded, PipelineModel) and loaded.transform(late).count() == 60


def test_a_cost_model_with_corrections(spark, rows):
    label = F.col("final_cost_overrun_pct") + F.when(F.col("stage") == "late", 7.0).otherwise(0.0)
    own = M.Features(("a",))
    bent = rows.withColumn("y", label)
    estimator = M.families("y", "weight")["linear"]
    oof = crossfit.rolling_out_of_fold(bent.where("completion_year < 2015"), own, "completion_year", "canonical_id", estimator)
    base = M.fit(bent.where("completion_year < 2015"), own, estimator)
    model = promoted.cost_model(oof, base, own, "y", "prediction", "weight", "stage", strength=1.0, out="said")
    late = bent.where("completion_year = 2015")
    found = model.transform(late)
    assert set(found.columns) == {*late.columns, "said"}
    error = lambda df, c: df.agg(F.avg(F.abs(F.col("y") - F.col(c)))).first()[0]
    assert error(found, "said") < 0.5 * error(M.predict(base, late, own), "prediction")


PLAN = retrain.Plan(M.Features(("a",), ("stage",)), M.Features((), ("office",)))


def test_one_call_trains_publishes_reports_and_records(spark, rows, tmp_path):
    root = f"file://{tmp_path}/runs"
    found = retrain.retrain(spark, rows, PLAN, 2010, 2013, 2015, root, "r1", "2024-01-01", classes=3)
    assert found["decision"] == "promote" and found["metrics"]["cost"]["mae"] < 1 and found["metrics"]["risk"]["accuracy"] > 0.5
    models, metadata = B.load(spark, found["path"], ("cost", "delay", "risk"))
    assert metadata["targets"] == {"cost": "final_cost_overrun_pct", "delay": "final_delay_days", "risk": "risk"}
    assert spark.read.parquet(found["validation"]).count() == 120
    text = (tmp_path / "runs" / "reports" / "2010_2013-r1.md").read_text()
    assert text.count("| lifecycle |") == 2
    entries = B.entries(spark, f"{root}/registry", "experiment string, run string, decision string").collect()
    assert [tuple(r) for r in entries] == [("window-2010_2013", "r1", "promote")]
    # A second run on spoiled rows is worse: it is recorded, and the bundle stays.
    spoiled = rows.withColumn("final_cost_overrun_pct", F.when(F.col("completion_year") < 2014, -F.col("final_cost_overrun_pct")).otherwise(F.col("final_cost_overrun_pct")))
    costs = retrain.Plan(PLAN.base, M.Features(()), {"cost": "final_cost_overrun_pct"}, risk=None)
    again = retrain.retrain(spark, spoiled, costs, 2010, 2013, 2015, root, "r2", "2024-02-01", classes=3)
    assert again["decision"] == "hold" and again["worse"] == ["cost"]
    assert B.check(spark, found["path"])[1]["run"] == "r1"
    with pytest.raises(ValueError, match="too few"):
        retrain.retrain(spark, rows.where("canonical_id < 3"), PLAN, 2010, 2013, 2015, f"file://{tmp_path}/none", "r1", "2024-01-01")
    assert not (tmp_path / "none").exists()


def test_bundles_are_compared_on_rows_that_none_has_seen(spark, rows, tmp_path):
    own = M.Features(("a",), ("stage",))
    parts = {"old": rows.where("completion_year < 2012"), "new": rows.where("completion_year < 2014")}
    for name, part in parts.items():
        B.save(spark, {"delay": M.fit(part, own, M.families("final_delay_days", "weight")["linear"])}, {"target_features": {"delay": ["a", "stage"]}}, f"file://{tmp_path}/{name}", name, "d", ["a", "stage"])
    models, told = retrain.bundle_models(spark, {n: f"file://{tmp_path}/{n}" for n in parts}, "delay", ("stage",))
    assert told["old"]["run"] == "old"
    found = {r["model"]: r for r in retrain.compared(rows, models, "final_delay_days", "weight", "canonical_id", parts).collect()}
    assert {r["rows"] for r in found.values()} == {120} and {r["entities"] for r in found.values()} == {60}
    assert sum(r["wins"] for r in found.values()) == 120
    late = rows.where("completion_year >= 2014")
    for name, (model, features) in models.items():
        want = M.predict(model, late, features).agg(F.sum(F.col("weight") * F.abs(F.col("prediction") - F.col("final_delay_days"))) / F.sum("weight")).first()[0]
        assert math.isclose(found[name]["mae"], want, rel_tol=1e-9)
    with pytest.raises(ValueError, match="all models may judge"):
        retrain.compared(parts["old"], models, "final_delay_days", "weight", "canonical_id", parts)
    path = retrain.evolution(rows.where("canonical_id = 7"), models, "canonical_id", "snapshot").orderBy("model", "snapshot").collect()
    assert [r["model"] for r in path] == ["new", "new", "old", "old"] and [r["change"] is None for r in path] == [True, False, True, False]
    assert math.isclose(path[1]["change"], path[1]["predicted"] - path[0]["predicted"])


def test_required_windows_are_told_in_one_report(spark, rows, tmp_path):
    plan = retrain.Plan(M.Features(("a",)), M.Features(()), {"cost": "final_cost_overrun_pct"}, risk=None)
    found = retrain.required_windows(spark, rows, plan, f"file://{tmp_path}/runs", "r1", "2024-01-01", ((2010, 2012, 2013), (2030, 2031, 2032)))
    assert list(found["windows"]) == ["2010_2012"] and "too few" in found["failed"]["2030_2031"]
    text = (tmp_path / "runs" / "reports" / "windows-r1.md").read_text()
    assert "| 2010_2012 | cost |" in text and "2030_2031 could not be trained" in text
    with pytest.raises(ValueError, match="too few"):
        retrain.required_windows(spark, rows, plan, f"file://{tmp_path}/none", "r1", "2024-01-01", ((2030, 2031, 2032),))


def test_a_blend_is_one_pipeline_that_bundles_keep(spark, rows, tmp_path):
    early, late = rows.where("completion_year < 2015"), rows.where("completion_year = 2015")
    model, weights = promoted.blend_model(early, M.Features(("a",)), "final_cost_overrun_pct", "weight", "completion_year", "canonical_id", folds=2)
    assert math.isclose(sum(weights.values()), 1.0) and set(weights) == {"linear", "forest", "boosted"} and weights["linear"] >= 0.5
    found = model.transform(late)
    assert set(found.columns) == {*rows.columns, "prediction"}
    assert found.agg(F.avg(F.abs(F.col("prediction") - F.col("final_cost_overrun_pct")))).first()[0] < 1
    path = f"file://{tmp_path}/bundle"
    B.save(spark, {"cost": model}, {}, path, "r1", "d1", ["a"])
    read = lambda m: sorted((r["canonical_id"], r["stage"], round(r["prediction"], 9)) for r in m.transform(late).collect())
    assert read(B.load(spark, path)[0]["cost"]) == read(model)


# Experiments


@pytest.fixture(scope="module")
def works(spark):
    """Costs that rise in steps; the last value depends on how often they have risen."""
    rng, out = random.Random(21), []
    for e in range(150):
        year, cost, steps = 2010 + e // 25, 100.0, 0
        times = rng.randrange(4)
        for k in range(6):
            if k and k <= times:
                cost, steps = cost * 1.1, steps + 1
            out.append((e, 30 * k, date(year, 1, 1) + timedelta(days=30 * k), year, cost, cost - 100, 0.0, "early" if k < 3 else "late", "s", float(k), 50.0 + k + 40.0 * steps + rng.gauss(0, 0.5)))
    schema = "entity long, day int, as_of date, year int, cost double, escalation double, slippage double, stage string, sector string, k double, actual double"
    return spark.createDataFrame(out, schema).withColumn("weight", W.balanced_weight("entity"))


def test_an_experiment_from_stages_to_its_entry(spark, works, tmp_path):
    root, context = f"file://{tmp_path}/runs", {"features": ["k"], "test_year": 2015, "folds": 2, "metric": "mae"}
    frozen = versions.freeze(spark, f"{root}/contexts", context)
    found = experiments.run(spark, experiments.TrajectoryCost, {"rows": works}, context, frozen, root, "r1", "2024-01-01")
    assert found["decision"] == "promote" and found["gain"] > 10 and found["interval"][0] > 0
    assert [s["reused"] for s in found["stages"]] == [False, False]
    book = spark.read.parquet(f"{root}/ledgers/trajectory-cost/r1")
    assert book.count() == 150 and book.where("abs(challenger - baseline) > 1e-9").count() > 0
    again = experiments.run(spark, experiments.TrajectoryCost, {"rows": works}, context | {}, frozen, root, "r2", "2024-01-02")
    assert all(s["reused"] for s in again["stages"]) and again["cohort"] == found["cohort"] and again["ledger"] == found["ledger"]
    entries = B.entries(spark, f"{root}/registry", "experiment string, run string, decision string, gain double").collect()
    assert sorted((r["run"], r["decision"]) for r in entries) == [("r1", "promote"), ("r2", "promote")]
    with pytest.raises(ValueError, match="metric"):
        experiments.run(spark, experiments.TrajectoryCost, {"rows": works}, context | {"metric": "rmse"}, frozen, root, "r3", "2024-01-03")


def test_a_failing_experiment_stops_no_other(spark, works, tmp_path):
    root, context = f"file://{tmp_path}/runs", {"features": ["k"], "test_year": 2015, "folds": 2, "cohort": "another"}
    frozen = versions.freeze(spark, f"{root}/contexts", context)

    class Broken:
        NAME = "broken"

        @staticmethod
        def stages(context):
            raise RuntimeError("no stages today")

    found = experiments.registry()
    found.add("broken", Broken)
    found.add("trajectory-cost", experiments.TrajectoryCost)
    out = experiments.run_all(spark, found, {"rows": works}, context, frozen, root, "r1", "2024-01-01")
    assert out["broken"] == "RuntimeError: no stages today" and "cohort" in out["trajectory-cost"]
