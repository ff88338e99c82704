"""Training over time, bundles with provenance, paths and rates, on small invented tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.ml import bundles as B
from tidemark.ml import lifecycle as L
from tidemark.ml import models as M
from tidemark.operators import paths, splits
from tidemark.operators import windows as W


@pytest.fixture(scope="module")
def rows(spark):
    """Five years of 60 entities, two rows each; y is 3 a + 10 in sector one and 3 a + 30 in sector two; ``noise`` says nothing."""
    n = spark.range(600).withColumn("entity", F.floor(F.col("id") / 2)).withColumn("yr", (2010 + F.floor(F.col("entity") / 60)).cast("int"))
    n = n.withColumns({"a": (F.col("id") * 7 % 23).cast("double"), "noise": (F.col("id") * 13 % 5).cast("double"), "sector": F.when(F.col("entity") % 3 == 0, "two").otherwise("one")})
    n = n.withColumns({"stage": F.when(F.col("id") % 2 == 0, "early").otherwise("late"), "empty": F.lit(None).cast("double")})
    y = F.col("a") * 3 + F.when(F.col("sector") == "two", 30.0).otherwise(10.0)
    return n.withColumn("y", y).withColumn("w", W.balanced_weight("entity"))


A = L.Features(("a",))


def test_rolling_validation_trains_on_earlier_years_only(rows):
    found = L.rolling_validation(rows, A, "y", "w", "yr", "entity").collect()
    assert [r["fold"] for r in found] == [2012, 2013, 2014]
    assert all(r["rows"] == 120 and 7 < r["mae"] < 11 for r in found)
    spoiled = rows.withColumn("y", F.when(F.col("yr") == 2014, F.col("y") + 1000).otherwise(F.col("y")))
    again = L.rolling_validation(spoiled, A, "y", "w", "yr", "entity").collect()
    assert [r["mae"] for r in again[:2]] == [r["mae"] for r in found[:2]] and again[2]["mae"] > 900


def test_expanding_baseline_by_hand(spark):
    t = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 30.0), (3, 5.0)], "yr int, v double")
    assert {r["yr"]: (r["mae"], r["n"]) for r in L.expanding_baseline(t, "yr", "v").collect()} == {2: (15.0, 1), 3: (15.0, 1)}


def test_sector_correction_is_enabled_where_it_helps(rows):
    r = L.sector_correction(rows, A, "y", "w", "yr", "sector").first()
    assert (r["correction_year"], r["validation_year"], r["enabled"]) == (2013, 2014, True)
    assert r["corrected_mae"] < 2 < r["mae"]
    even = rows.withColumn("y", F.col("a") * 3)  # nothing that a sector could tell
    assert L.sector_correction(even, A, "y", "w", "yr", "sector").first()["mae"] < 1
    with pytest.raises(ValueError, match="three years"):
        L.sector_correction(rows.where("yr < 2012"), A, "y", "w", "yr", "sector")


def test_corrections_shrink_small_sectors(spark):
    t = spark.createDataFrame([("a", 6.0)] * 5 + [(None, 6.0)], "s string, e double")
    assert {r["s"]: r["correction"] for r in L.corrections(t, "s", F.col("e")).collect()} == {"a": 3.0, None: 1.0}
    held = spark.createDataFrame([("a", 1.0), (None, 1.0), ("b", 1.0)], "s string, prediction double")
    got = L.corrected(held, L.corrections(t, "s", F.col("e")), "s").collect()
    assert {r["s"]: r["prediction"] for r in got} == {"a": 4.0, None: 2.0, "b": 1.0}


def test_feature_groups(rows):
    found = {r["variant"]: r for r in L.group_selection(rows, L.Features(("a", "noise"), ("sector",)), "y", "w", "yr", {"size": ("a",), "place": ("sector",)}).collect()}
    assert found["all"]["chosen"] and found["without size"]["mae"] > 10 and found["without place"]["mae"] > 5


def test_specialists_need_enough_entities(rows):
    few = rows.where("stage = 'early' OR entity >= 295 OR entity < 5")
    found = {r["stage"]: r for r in L.stage_specialists(few, A, "y", "w", "yr", "entity", "stage").collect()}
    assert found["early"]["mae"] is not None and found["early"]["train_entities"] == 240
    assert found["late"]["mae"] is None and found["late"]["global_mae"] is not None and found["late"]["test_entities"] == 5


def test_targets_are_scored_on_the_value(rows):
    exact = rows.withColumn("y", F.col("a") * 3 + 10)
    found = {r["target"]: r["mae"] for r in L.targets_compared(exact.withColumn("now", F.col("a") * 2), A, "y", "now", "w", "yr").collect()}
    assert set(found) == {"direct", "residual", "signed log", "huber"}
    assert found["direct"] < 0.5 and found["residual"] < 0.5 and found["huber"] < 0.5 < found["signed log"]


def test_targets_share_what_prepares_their_features(rows, monkeypatch):
    from pyspark.ml.feature import Imputer

    fits, own = [], Imputer._fit
    monkeypatch.setattr(Imputer, "_fit", lambda self, df: fits.append(1) or own(self, df))
    L.targets_compared(rows.withColumn("now", F.col("a") * 2), A, "y", "now", "w", "yr")
    assert len(fits) == 1


def test_huber_withstands_outliers(rows):
    spoiled = rows.withColumn("y", F.when(F.col("id") % 50 == 0, 5000.0).otherwise(F.col("a") * 3 + 10))
    plain, robust = (L.scores(M.predict(M.fit(spoiled, A, e), rows, A).withColumn("y", F.col("a") * 3 + 10), "y", "w")["mae"] for e in (L._linear("y", "w"), L.huber("y", "w")))
    assert robust < 2 < plain


def test_a_single_class_is_predicted_without_a_model(rows):
    got = L.classify(rows.withColumn("c", F.lit(2)), A, "c", 3)(rows)
    assert [r["prediction"] for r in got.select("prediction").distinct().collect()] == [2.0]
    both = L.classify(rows.withColumn("c", (F.col("a") > 10).cast("int")), A, "c", 2)(rows)
    assert both.where((F.col("prediction") == 1) != (F.col("a") > 10)).count() == 0
    with pytest.raises(ValueError, match="no row"):
        L.classify(rows.withColumn("c", F.lit(None).cast("int")), A, "c", 2)


def test_completion_by_year_rises_and_matches_the_distribution(rows):
    t = rows.withColumn("days", F.col("a") * 40 + 100).withColumn("seen", F.lit(1.0)).withColumn("begin", F.lit("2010-07-01").cast("date"))
    model = M.survival(t, A, "days", "seen")
    found = L.completion_by_year(model, t.where("id = 1"), A, "begin", 2013).orderBy("year").collect()
    assert [r["year"] for r in found] == [2010, 2011, 2012, 2013]
    shares = [r["completed"] for r in found]
    assert shares == sorted(shares) and 0 < shares[0] and shares[-1] <= 1
    late = M.predict(model, t.where("id = 1"), A).first()["prediction"]
    assert shares[0] == pytest.approx(1 - math.exp(-((183 / late) ** (1 / model.stages[-1].scale))))


def test_archive_status(spark):
    t = spark.createDataFrame([(i % 12, 1, 1 if i < 35 else None) for i in range(40)], "e int, s int, c int")
    r = L.archive_status(t, "e", "s", "c").first()
    assert (r["rows"], r["entities"], r["schedule_labels"], r["cost_labels"], r["sufficient"]) == (40, 12, 40, 35, True)
    assert L.archive_status(t.limit(0), "e", "s", "c").first()["sufficient"] is False


def test_promotion_needs_a_gain_and_no_worse_stage(spark):
    book = lambda *r: spark.createDataFrame(r, "stage string, weight double, actual double, baseline double, challenger double")
    good = L.promotion(book(("a", 1.0, 10.0, 20.0, 12.0), ("b", 1.0, 10.0, 14.0, 14.0))).first()
    assert good["promote"] and good["worse_stages"] == 0 and good["gain"] == pytest.approx(800 / 14)
    bad = L.promotion(book(("a", 1.0, 10.0, 20.0, 10.0), ("b", 1.0, 10.0, 11.0, 12.0))).first()
    assert not bad["promote"] and bad["worse_stages"] == 1
    assert L.promotion(book(("a", 1.0, 1.0, 1.0, 1.0))).first()["promote"] is False


def test_train_window_guards_audits_and_reports(rows):
    more = L.Features(("noise", "empty"), ("sector",))
    got = L.train_window(rows, A, more, "y", "w", "yr", "entity", "stage", 2010, 2012, 2014, {"place": ("sector",)})
    assert got["entities"] == [180, 120] and got["features"] == ["a", "noise", "sector"]  # the empty column is left out
    assert set(got["variants"]) == {"baseline", "lifecycle", "without place"}
    assert got["variants"]["lifecycle"]["mae"] < got["variants"]["baseline"]["mae"]
    assert set(got["variants"]["baseline"]["stages"]) == {"early", "late"} and got["held"].count() == 240
    text = L.report([got])
    assert "## 2010 to 2012, tested on 2013 to 2014" in text and text.count("| without place |") == 1
    call = lambda df, first=2010: L.train_window(df, A, more, "y", "w", "yr", "entity", "stage", first, 2012, 2014)
    with pytest.raises(ValueError, match="too few"):
        call(rows, 2013)
    with pytest.raises(ValueError, match="both sides"):
        call(rows.withColumn("entity", F.col("entity") % 60))
    with pytest.raises(ValueError, match="weights"):
        call(rows.withColumn("w", F.lit(1.0)))


def test_bundles_are_loaded_only_if_they_are_what_was_saved(spark, rows, tmp_path):
    path, model = f"file://{tmp_path}/bundle", M.fit(rows, A, L._linear("y", "w"))
    mark = B.save(spark, {"cost": model}, {"window": "2010_2014"}, path, "run1", "data1", ["a"], {"rows": "x"})
    assert mark["status"] == "complete" and set(mark["models"]) == {"cost"}
    models, meta = B.load(spark, path, ("cost",), {"rows": "x"})
    assert meta["window"] == "2010_2014" and meta["run"] == "run1"
    both = [M.predict(m, rows, A).orderBy("id").select("prediction").limit(5).collect() for m in (model, models["cost"])]
    assert both[0] == both[1]
    with pytest.raises(ValueError, match="source rows was changed"):
        B.load(spark, path, (), {"rows": "y"})
    with pytest.raises(ValueError, match="model delay is missing"):
        B.load(spark, path, ("delay",))
    B.save(spark, {"cost": model}, {}, path, "run2", "data1", ["a"])  # takes the place of the first
    assert B.load(spark, path)[1]["run"] == "run2"
    part = next((tmp_path / "bundle" / "models" / "cost").rglob("part-*"))
    part.write_bytes(part.read_bytes() + b" ")
    next(part.parent.glob(f".{part.name}.crc"), part).unlink()
    if not part.exists():
        part.write_bytes(b"x")
    with pytest.raises(ValueError, match="model cost was changed"):
        B.check(spark, path)
    with pytest.raises(ValueError, match="no provenance"):
        B.check(spark, f"file://{tmp_path}/nothing")


def test_a_forecast_reads_the_last_row_of_each_entity(spark, rows, tmp_path):
    path = f"file://{tmp_path}/bundle"
    B.save(spark, {"cost": M.fit(rows, A, L._linear("y", "w")), "other": M.fit(rows, A, L.huber("y", "w"))}, {}, path, "run1", "data1", ["a"])
    got = B.forecast(spark, path, rows.where("entity < 5"), A, "entity", "yr", "id").orderBy("entity").collect()
    assert [(r["entity"], r["id"]) for r in got] == [(e, 2 * e + 1) for e in range(5)]
    assert all(r["run"] == "run1" and r["predicted_cost"] is not None and r["predicted_other"] is not None for r in got)


def test_registry_entries_cannot_be_changed(spark, tmp_path):
    root, one = f"file://{tmp_path}/runs", {"experiment": "e1", "run": "r1", "recorded_at": "2024-05-01", "decision": "hold", "gain": 3.5}
    B.record(spark, one, root)
    B.record(spark, one, root)
    B.record(spark, one | {"run": "r2", "decision": "promote"}, root)
    got = B.entries(spark, root, "experiment string, run string, decision string, gain double").orderBy("run").collect()
    assert [(r["run"], r["decision"], r["gain"]) for r in got] == [("r1", "hold", 3.5), ("r2", "promote", 3.5)]
    for bad, why in ((one | {"gain": 9}, "another entry"), (one | {"decision": "maybe"}, "none of"), ({"run": "r"}, "lacks"), (one | {"run": "../x"}, "folder")):
        with pytest.raises(ValueError, match=why):
            B.record(spark, bad, root)


def test_later_rows_never_change_a_path_or_a_rate(spark):
    data = [(k, d * 30, float(100 + (d * k) % 7), float(d % 4 - 1), 90.0, 40.0 + d, 400.0, 50.0) for k in (1, 2) for d in range(12)]
    t = spark.createDataFrame(data, "k int, day int, cost double, slip double, approved double, spent double, planned double, expected double").withColumn("esc", X.pct_change("approved", "cost"))

    def features(df):
        p = paths.path_features(df, "k", "cost", "esc", "slip")
        return paths.scaled_rates(p, "k", "approved", "cost", "spent", "slip", "planned", "expected").where("day <= 180").orderBy("k", "day").collect()

    assert features(t) == features(t.where("day <= 180"))
    assert set(paths.PATH) <= set(paths.path_features(t, "k", "cost", "esc", "slip").columns)


def test_paths_by_hand(spark):
    t = spark.createDataFrame([(1, 0, 100.0, 0.0), (1, 30, 150.0, None), (1, 60, 150.0, 5.0), (1, 90, 75.0, 2.0)], "k int, day int, cost double, slip double").withColumn("esc", F.col("cost") - 100)
    got = [r.asDict() for r in paths.path_features(t, "k", "cost", "esc", "slip").orderBy("day").collect()]
    assert [r["cost_revision_count"] for r in got] == [0, 1, 1, 2] and [r["schedule_revision_count"] for r in got] == [0, 0, 0, 1]
    assert [r["abs_cost_revision_pct"] for r in got] == [0.0, 50.0, 50.0, 100.0]
    assert [r["max_slippage"] for r in got] == [0.0, None, 5.0, 5.0] and [r["slippage_recovery"] for r in got] == [0.0, None, 0.0, 3.0]
    assert [r["slippage_positive_share"] for r in got] == [0.0, 0.0, 0.5, pytest.approx(2 / 3)]
    assert [r["escalation_worsening_share"] for r in got] == [None, 1.0, 0.5, pytest.approx(1 / 3)]
    assert [r["months_since_first_cost_revision"] for r in got] == [-1.0, 0.0, pytest.approx(30 / 30.4375), pytest.approx(60 / 30.4375)]


def test_row_split_ties_and_empty_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e")], "d int, k string")
    train, test = splits.by_rows(t, ["d", "k"], 0.4)
    assert sorted(r["k"] for r in train.collect()) == ["a", "b", "e"] and sorted(r["k"] for r in test.collect()) == ["c", "d"]
    assert [df.count() for df in splits.by_rows(t.limit(0), ["d"], 0.4)] == [0, 0]


def test_small_expressions(spark):
    u = spark.range(1)
    value = lambda c: u.select(c.alias("x")).first()["x"]
    null = F.lit(None).cast("double")
    assert value(X.progress_shortfall(F.lit(40.0), F.lit(55.0))) == -15.0 and value(X.progress_shortfall(F.lit(40.0), null)) is None
    assert value(X.complexity(F.lit(math.e - 1), null, F.lit(4), F.lit(-3))) == pytest.approx(1.1) and value(X.complexity(null, null, null, null)) is None
    assert [value(X.mentions_delay(F.lit(s))) for s in ("Slipped by two", "OVERDUE", "on time", None)] == [1, 1, 0, 0]
    assert [X.clamped_limit(n, 50) for n in (-3, 0, 7, 900)] == [1, 1, 7, 50]
