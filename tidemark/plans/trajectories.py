"""From snapshots and outcomes to weighted training rows, all of it known as of each snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import expr as X
from tidemark.operators import joins as J
from tidemark.operators import paths
from tidemark.operators import windows as W

# Trailing days of three, six and twelve months, and what tells the outcome.
QUARTER, HALF, YEAR = 93, 186, 366
OUTCOMES = ("final_cost_overrun_pct", "final_delay_days", "risk", "completion_date", "outcome_amount")


def with_identity(snapshots: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Adds the canonical key, the audit of how it was found, and the final cost and delay of verified rows."""
    out = outcomes.select(
        F.col("project_id").alias("outcome_id"), X.name_key("project_name").alias("outcome_key"), F.col("approved_cost_cr").alias("outcome_amount"),
        F.col("planned_commissioning_date").alias("outcome_planned"), F.col("reported_completion_expenditure_cr").alias("final_cost"), "completion_date",
    )
    rows = snapshots.withColumn("entity_id", F.col("project_id")).withColumn("name_key", X.name_key("project_name")).withColumn("amount", F.col("approved_cost_cr"))
    found = J.resolve_identity(rows, out)
    basis = F.coalesce("approved_cost_cr", "outcome_amount")
    planned = F.coalesce("planned_completion_date", "outcome_planned")
    delay = X.delay_days("completion_date", planned)
    return (
        found.withColumn("canonical_id", F.coalesce(F.when(F.col("verified"), F.col("outcome_id")), X.fallback_key("project_id", "project_name", "implementing_agency")))
        .withColumn("final_cost_overrun_pct", X.pct_change(basis, "final_cost")).withColumn("final_delay_days", delay).withColumn("risk", X.risk_label(delay))
    )


def as_of_features(rows: DataFrame) -> DataFrame:
    """Direct and trailing features; only the current and earlier snapshots of an entity enter."""
    key = "canonical_id"
    start = F.coalesce("planned_start_date", "approval_date")
    planned_days, elapsed = X.days("planned_completion_date", start), X.days("snapshot_date", start)
    expected = X.clamp(X.ratio(elapsed, planned_days) * 100, 0.0, 100.0)
    df = (
        rows.withColumn("day", W.day_number("snapshot_date"))
        .withColumn("expenditure_ratio", X.ratio("cumulative_expenditure_cr", "approved_cost_cr"))
        .withColumn("cost_escalation_pct", X.pct_change("approved_cost_cr", "revised_cost_cr"))
        .withColumn("planned_duration_days", planned_days).withColumn("elapsed_days", elapsed).withColumn("elapsed_ratio", X.ratio(elapsed, planned_days))
        .withColumn("schedule_slippage_days", X.days("revised_completion_date", "planned_completion_date"))
        .withColumn("slippage_ratio", X.ratio(X.days("revised_completion_date", "planned_completion_date"), planned_days))
        .withColumn("progress_deviation", F.col("physical_progress") - expected)
        .withColumn("size", X.band("approved_cost_cr", X.SIZE4)).withColumn("stage", X.band(X.ratio(elapsed, planned_days), X.STAGES))
        .withColumn("start_source", F.when(F.col("planned_start_date").isNotNull(), "planned").when(F.col("approval_date").isNotNull(), "approval"))
    )
    df = W.one_per_day(df, key, "day", "source_report")
    df = paths.scaled_rates(
        df.withColumn("_expected", expected), key, "approved_cost_cr", "revised_cost_cr", "cumulative_expenditure_cr", "schedule_slippage_days", "planned_duration_days", "_expected", widths=(QUARTER, HALF, YEAR)
    ).drop("_expected")
    for name, x in (("cost", "cost_escalation_pct"), ("progress", "physical_progress"), ("slippage", "schedule_slippage_days")):
        df = df.withColumn(f"{name}_velocity_3m", W.slope(x, key, QUARTER)).withColumn(f"{name}_velocity_6m", W.slope(x, key, HALF))
        df = df.withColumn(f"{name}_acceleration", F.col(f"{name}_velocity_3m") - F.col(f"{name}_velocity_6m"))
    effective = F.coalesce("revised_completion_date", "planned_completion_date")
    df = df.withColumn("date_revised", W.revised(effective, key)).withColumn("cost_revised", W.revised("revised_cost_cr", key))
    df = df.withColumn("_d", W.change("cost_escalation_pct", key))
    return (
        df.withColumn("date_revisions_12m", W.trailing_count("date_revised", key, YEAR)).withColumn("cost_revisions_12m", W.trailing_count("cost_revised", key, YEAR))
        .withColumn("months_since_revision", W.months_since("date_revised", key)).withColumn("cost_volatility_12m", W.trailing_std("_d", key, YEAR)).withColumn("history_depth_12m", W.depth(key, YEAR)).drop("_d")
    )


def with_priors(df: DataFrame) -> DataFrame:
    """Adds means of outcomes completed strictly before each snapshot: by agency, by sector if fewer than three, else
    over all. One outcome an entity counts: that of its first verified snapshot."""
    known = df.where(F.col("verified") & F.col("completion_date").isNotNull() & F.col("final_delay_days").isNotNull() & F.col("final_cost_overrun_pct").isNotNull())
    facts = W.pick(known, ["canonical_id"], ["day", "source_report"]).withColumn("day", W.day_number("completion_date"))
    facts = facts.select("day", "sector", "implementing_agency", "final_delay_days", "final_cost_overrun_pct")
    m = {
        "delay": F.col("final_delay_days"), "cost": F.col("final_cost_overrun_pct"),
        "delay_rate": (F.col("final_delay_days") >= 90).cast("int"), "cost_rate": (F.col("final_cost_overrun_pct") > 0).cast("int"),
    }
    for by, prefix in (((), "overall"), (("sector",), "sector_prior"), (("implementing_agency",), "agency_prior")):
        # A missing label is a group of its own for the join, and has no facts.
        own = facts.where(F.col(by[0]).isNotNull()) if by else facts
        df = J.earlier_stats(df, own, "day", m, by, prefix)
    for k in m:
        df = df.withColumn(f"prior_sector_{k}", J.with_fallback(df, ["sector_prior", "overall"], k)).withColumn(f"prior_agency_{k}", J.with_fallback(df, ["agency_prior", "sector_prior", "overall"], k))
    return df.drop(*(f"{p}_{k}" for p in ("overall", "sector_prior", "agency_prior") for k in (*m, "n")))


def training_rows(df: DataFrame) -> DataFrame:
    """Verified rows before completion with both targets, the last of each quarter, weighted so that entities weigh 1."""
    ok = F.col("verified") & F.col("final_cost_overrun_pct").isNotNull() & F.col("final_delay_days").isNotNull() & (F.col("snapshot_date") < F.col("completion_date"))
    kept = W.quarter_last(df.where(ok), "canonical_id", "snapshot_date", "source_report")
    return kept.withColumn("sample_weight", W.balanced_weight("canonical_id")).withColumn("completion_year", F.year("completion_date"))


def require_as_of(rows: DataFrame) -> None:
    """Raises unless all rows are verified, precede their completion, and weigh 1 an entity."""
    bad = rows.agg(
        F.count(F.when(F.col("snapshot_date") >= F.col("completion_date"), 1)).alias("late"), F.count(F.when(~F.col("verified"), 1)).alias("unverified")
    ).first()
    off = rows.groupBy("canonical_id").agg(F.sum("sample_weight").alias("w")).where(F.abs(F.col("w") - 1) > 1e-9).limit(1).count()
    if bad["late"] or bad["unverified"] or off:
        raise ValueError(f"not as of: {bad['late']} rows after completion, {bad['unverified']} unverified, weights off: {bool(off)}")


def build(snapshots: DataFrame, outcomes: DataFrame) -> DataFrame:
    return training_rows(with_priors(as_of_features(with_identity(snapshots, outcomes))))
