"""Trajectories, evidence, sessions, streams and models on small fixtures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.ml import models as M
from tidemark.operators import governance as G
from tidemark.operators.sessions import Session
from tidemark.plans import trajectories as T
from tidemark.sources.schemas import OUTCOME, SNAPSHOT, columns, fit_contract
from tidemark.streaming import snapshots as S

D = dt.date


#: A weir of 240 sanctioned, 400 days planned from 1 May 2014; twice at 252, then at 270; and two works without a code.
WEIR, SLUICE = "Q71000081", "Q71000085"


def snapshots(spark, extra=()):
    base = {"sector": "Weirs", "implementing_agency": "River Board", "approved_cost_cr": 240.0, "planned_start_date": D(2014, 5, 1), "planned_completion_date": D(2015, 6, 5)}
    weir = {"project_id": WEIR, "project_name": "Upper Weir"}
    rows = [
        weir | {"snapshot_date": D(2014, 8, 9), "revised_cost_cr": 252.0, "cumulative_expenditure_cr": 36.0, "revised_completion_date": D(2015, 8, 4), "physical_progress": 10.0},
        weir | {"snapshot_date": D(2014, 9, 30), "revised_cost_cr": 252.0, "cumulative_expenditure_cr": 60.0, "revised_completion_date": D(2015, 8, 4), "physical_progress": 20.0},
        weir | {"snapshot_date": D(2014, 10, 30), "revised_cost_cr": 270.0, "cumulative_expenditure_cr": 90.0, "revised_completion_date": D(2016, 1, 1), "physical_progress": 45.0},
        {"project_id": None, "project_name": "Eel Pass", "snapshot_date": D(2014, 10, 30)},
        {"project_id": SLUICE, "project_name": "Lower Sluice", "snapshot_date": D(2017, 3, 31), "revised_cost_cr": 300.0},
        *extra,
    ]
    names = list(columns(SNAPSHOT))
    data = [tuple((base | {"source_report": f"r{i}"} | r).get(c) for c in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SNAPSHOT)


def outcomes(spark):
    rows = [
        (WEIR, "Upper Weir", "Weirs", "River Board", 240.0, D(2015, 6, 5), 300.0, D(2016, 2, 10), None, None),
        ("Q71000082", "Eel Pass", "Weirs", "River Board", 240.0, D(2015, 1, 1), 250.0, D(2017, 8, 1), None, None),
        ("Q71000083", "Eel Pass", "Weirs", "Fish Office", 240.0, D(2015, 1, 1), 260.0, D(2018, 8, 1), None, None),
        (SLUICE, "Lower Sluice", "Weirs", "Gate Works", 240.0, D(2015, 6, 5), 216.0, D(2018, 1, 15), None, None),
    ]
    return spark.createDataFrame(rows, OUTCOME)


def test_features_and_priors_computed_by_hand(spark):
    df = T.with_priors(T.as_of_features(T.with_identity(snapshots(spark), outcomes(spark))))
    got = {(r["project_name"], r["snapshot_date"]): r for r in df.collect()}
    a = got["Upper Weir", D(2014, 8, 9)]
    # 36 of 240 spent, 252 over 240, 60 days of slip, day 100 of 400 with a tenth built.
    assert (a["expenditure_ratio"], a["cost_escalation_pct"], a["planned_duration_days"], a["schedule_slippage_days"], a["progress_deviation"]) == (0.15, 5.0, 400, 60, -15.0)
    # It ended at 300, 250 days late.
    assert (a["final_cost_overrun_pct"], a["final_delay_days"], a["risk"], a["method"]) == (25.0, 250, "MEDIUM", "exact_id")
    b = got["Upper Weir", D(2014, 10, 30)]
    # Cost went from 5 % to 12.5 % above the approved in the 82 days since the first snapshot; the date moved once.
    assert b["cost_velocity_3m"] == pytest.approx(7.5 / (82 / 30.4375)) and b["date_revisions_12m"] == 1 and b["history_depth_12m"] == 3
    assert got["Eel Pass", D(2014, 10, 30)]["method"] == "ambiguous_name" and a["prior_sector_delay"] is None
    later = got["Lower Sluice", D(2017, 3, 31)]
    assert (later["prior_sector_delay"], later["prior_agency_cost"]) == (250.0, 25.0)  # the weir had ended by then, nothing else


def test_training_rows_are_as_of_and_weigh_one(spark):
    rows = T.build(snapshots(spark), outcomes(spark))
    T.require_as_of(rows)
    got = {(r["project_name"], r["snapshot_date"]): r["sample_weight"] for r in rows.collect()}
    assert got == {("Upper Weir", D(2014, 9, 30)): 0.5, ("Upper Weir", D(2014, 10, 30)): 0.5, ("Lower Sluice", D(2017, 3, 31)): 1.0}
    with pytest.raises(ValueError, match="after completion"):
        T.require_as_of(rows.withColumn("completion_date", F.lit(D(2000, 1, 1))))


def test_appended_snapshots_change_no_earlier_row(spark):
    late = [{"project_id": WEIR, "project_name": "Upper Weir", "snapshot_date": D(2015, 3, 3), "revised_cost_cr": 4321.0, "physical_progress": 97.0, "revised_completion_date": D(2031, 7, 7)}]
    kept = ["canonical_id", "day", "cost_velocity_3m", "progress_acceleration", "date_revisions_12m", "cost_volatility_12m", "months_since_revision", "prior_sector_delay"]
    read = lambda df: {(r["canonical_id"], r["day"]): r.asDict() for r in T.with_priors(T.as_of_features(T.with_identity(df, outcomes(spark)))).select(kept).collect()}
    before, after = read(snapshots(spark)), read(snapshots(spark, late))
    assert len(after) == len(before) + 1 and all(after[k] == v for k, v in before.items())


def test_fingerprints_ignore_order_and_see_changes(spark):
    df = spark.createDataFrame([(1, 2.5, None), (2, None, "x"), (2, None, "x")], "a int, b double, c string")
    mark = G.fingerprint(df).first()
    assert mark == G.fingerprint(df.repartition(3).orderBy(F.desc("a")).select("c", "b", "a")).first()
    assert mark["digest"] != G.fingerprint(df.distinct()).first()["digest"]
    assert mark["digest"] != G.fingerprint(df.fillna(0)).first()["digest"]
    assert G.fingerprint(df.limit(0)).first()["rows"] == 0
    assert G.schema_fingerprint(["a", "b"]) != G.schema_fingerprint(["b", "a"])


def book(spark):
    return spark.createDataFrame([("B", D(2024, 1, 1), "early", "s", 1.0, 10.0, 12.0, 11.0), ("A", D(2024, 4, 1), "mid", "s", 0.5, 0.0, 1.0, 2.0)], "entity string, as_of date, stage string, sector string, weight double, actual double, baseline double, challenger double")


def test_ledger_is_checked_and_written_once(spark, tmp_path):
    rows = G.ledger(book(spark))
    manifest = G.write_ledger(rows, f"{tmp_path}/ledger")
    assert manifest["rows"] == 2 and manifest["digest"] == G.fingerprint(rows).first()["digest"]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        G.write_ledger(rows, f"{tmp_path}/ledger")
    with pytest.raises(ValueError, match="doubled"):
        G.write_ledger(rows.union(rows), f"{tmp_path}/other")
    with pytest.raises(ValueError, match="lacks"):
        G.ledger(book(spark).drop("weight"))
    assert G.same_cohort(rows, G.ledger(book(spark).withColumn("challenger", F.lit(0.0))))
    assert not G.same_cohort(rows, rows.where("entity = 'A'"))


def test_publish_replaces_and_cleans_up(spark, tmp_path):
    for i in (1, 2):
        spark.range(i).write.parquet(f"{tmp_path}/staged{i}")
        G.publish(spark, f"{tmp_path}/staged{i}", f"{tmp_path}/final")
        assert spark.read.parquet(f"{tmp_path}/final").count() == i
    assert not (tmp_path / "final.previous").exists()
    with pytest.raises(FileNotFoundError):
        G.publish(spark, f"{tmp_path}/absent", f"{tmp_path}/final")


def test_registry_and_decisions(spark):
    registry = G.Registry("matches")
    registry.add("a", type("A", (), {"matches": staticmethod(lambda text: True)}))
    with pytest.raises(ValueError):
        registry.add("a", registry["a"])
    with pytest.raises(TypeError):
        registry.add("b", object())
    runs = spark.createDataFrame([("e", "r", 1, 100.0, 95.0), ("e", "r", 2, 100.0, 85.0), ("f", "r", 1, 0.0, 1.0)], "experiment string, run string, recorded_at int, baseline double, challenger double")
    assert {r["experiment"]: r["promote"] for r in G.decisions(runs).collect()} == {"e": True, "f": False}
    with pytest.raises(ValueError, match="cohort"):
        G.RunContext("d", "c", "f", (1, 2, 3, 4)).require_same(G.RunContext("d", "x", "f", (1, 2, 3, 4)))


def test_sessions_hide_outcomes_until_predicted(spark, tmp_path):
    history = spark.createDataFrame([("A", 1, 5, 7.0), ("A", 4, 5, 7.0), ("A", 6, 5, 7.0), ("B", 2, 9, 8.0)], "k string, day int, ended int, y double")
    session = Session.open(history, f"{tmp_path}/s", "k", "day", "ended", ["y"])
    assert {(r["entity"], r["day"]) for r in session.rows().collect()} == {("A", 4), ("B", 2)}
    assert "y" not in session.rows().columns
    with pytest.raises(PermissionError):
        session.reveal()
    session.predict(spark.createDataFrame([("A", 6.5), ("Z", 1.0)], "entity string, predicted double"))
    assert [tuple(r) for r in Session(spark, f"{tmp_path}/s").reveal().collect()] == [("A", 6.5, 7.0)]
    session.predict(spark.createDataFrame([("A", 7.0), ("B", 8.0)], "entity string, predicted double"))  # too late for A
    assert sorted(tuple(r) for r in session.reveal().collect()) == [("A", 6.5, 7.0), ("B", 8.0, 8.0)]
    with pytest.raises(ValueError, match="2 times"):
        session.predict(spark.createDataFrame([("B", 1.0), ("B", 2.0)], "entity string, predicted double"))


def test_stream_keeps_the_newest_row_of_a_key(spark, tmp_path):
    schema = "k string, at timestamp, v int"
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    for batch in ([("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:00:00", 1)], [("a", "2024-01-02 00:00:00", 2)]):
        spark.createDataFrame(batch, "k string, at string, v int").selectExpr("k", "cast(at as timestamp) as at", "v").write.mode("append").parquet(source)
        S.upsert(spark.readStream.schema(schema).parquet(source), table, ["k"], "at", f"{tmp_path}/cp").awaitTermination()
    assert {r["k"]: r["v"] for r in S.current(spark, table, ["k"], "at").collect()} == {"a": 2, "b": 1}


def test_a_streamed_table_is_written_anew_now_and_then(spark, tmp_path):
    import os

    schema, source, table = "k string, at timestamp, v int", f"{tmp_path}/in", f"{tmp_path}/table"
    for day in range(1, 10):
        spark.createDataFrame([("a", f"2024-01-{day:02d} 00:00:00", day), (f"b{day}", "2024-01-01 00:00:00", day)], "k string, at string, v int").selectExpr("k", "cast(at as timestamp) as at", "v").write.mode("append").parquet(source)
        S.upsert(spark.readStream.schema(schema).parquet(source), table, ["k"], "at", f"{tmp_path}/cp", every=3).awaitTermination()
        assert {r["k"]: r["v"] for r in S.current(spark, table, ["k"], "at").collect()} == {"a": day} | {f"b{d}": d for d in range(1, day + 1)}
    names = sorted(n for n in os.listdir(table) if not n.startswith("."))
    assert sum(n.startswith("base-") for n in names) == 2 and sum(n.startswith("part-") for n in names) <= 6


def test_streamed_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    stream = S.daily_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), "at", "event_type")
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.groupBy(F.to_date("at").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))


def test_days_are_those_of_the_session(spark, tmp_path):
    """Half past eleven in the evening in one zone is the next day in another."""
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        events = spark.sql("SELECT timestamp'2024-03-01 23:30:00' AS at, 'x' AS kind UNION ALL SELECT timestamp'2024-03-02 00:30:00', 'x'")
        events.write.parquet(f"{tmp_path}/events")
        stream = S.daily_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), "at", "kind")
        stream.writeStream.format("memory").queryName("zoned").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        assert sorted((str(r["day"]), r["n"]) for r in spark.table("zoned").collect()) == [("2024-03-01", 1), ("2024-03-02", 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def rows(spark, n=400):
    df = spark.range(n).select(
        F.col("id").alias("i"), (2010 + F.col("id") % 5).cast("int").alias("yr"), F.when(F.col("id") % 11 != 0, (F.col("id") % 37).cast("double")).alias("a"),
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("c"), F.lit(1.0).alias("w"),
    )
    return df.withColumn("y", F.coalesce(F.col("a"), F.lit(18.0)) * 3 + F.when(F.col("c") == "x", 20.0).otherwise(0.0))


def test_models_learn_and_select(spark):
    f = M.Features(("a",), ("c",))
    df = rows(spark)
    name, model, scores = M.selected(df, f, "y", "w", "yr")
    assert scores.count() == 3 and scores.where(F.col("family") == name).first()["mae"] == scores.agg(F.min("mae")).first()[0]
    shares = dict(M.importance(model, f, df))
    assert set(shares) == {"a", "c"} and sum(shares.values()) == pytest.approx(1.0)
    mae = dict(M.ablations(df.where("yr < 2014"), df.where("yr = 2014"), f, "y", "w", {"no_a": ("a",)}))
    assert mae["no_a"] > 3 * mae["all"]


def test_blend_bands_and_two_stage(spark):
    df = rows(spark).withColumn("p", F.col("y") + 4).withColumn("q", F.col("y") - 4)
    best = M.best_blend(df, ["p", "q"], "y", "w").first()
    assert (best["w_p"], best["w_q"], best["mae"]) == (0.5, 0.5, 0.0)
    assert len(M.simplex_grid(3)) == 66
    assert M.bands(df, "y", "p").where("low = -4 and high = -4").count() >= 3
    out = M.two_stage(rows(spark), M.Features(("a",), ("c",)), "y", "w", 60.0)(rows(spark))
    near = out.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert near < rows(spark).agg(F.stddev("y")).first()[0]
    fit_contract(out, {"prediction": "double"})
