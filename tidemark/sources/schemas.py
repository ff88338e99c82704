"""Schemas of the domain tables, and fitting frames to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The columns of a monthly snapshot, in order.
SNAPSHOT = (
    "project_id string, project_name string, snapshot_date date, financial_year string, report_month string, sector string, ministry string, "
    "implementing_agency string, state string, approved_cost_cr double, revised_cost_cr double, cumulative_expenditure_cr double, approval_date date, "
    "planned_start_date date, planned_completion_date date, revised_completion_date date, actual_completion_date date, current_schedule_status string, "
    "physical_progress double, financial_progress double, milestone_status string, source_report string, source_url string, source_page int, parser_version string"
)
OUTCOME = (
    "project_id string, project_name string, sector string, implementing_agency string, approved_cost_cr double, planned_commissioning_date date, "
    "reported_completion_expenditure_cr double, completion_date date, financial_year string, source_url string"
)
PROJECT = (
    "snapshot_date date, sector string, ministry string, project_code string, project_name string, original_cost_cr double, revised_cost_cr double, "
    "expenditure_cr double, original_end_date date, revised_end_date date, physical_progress_pct double, source_url string"
)


def columns(ddl: str) -> dict[str, str]:
    return dict(part.strip().rsplit(" ", 1) for part in ddl.split(","))


def fit_contract(df: DataFrame, contract: dict[str, str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Exactly the contract's columns in its order: what df lacks is null, or the default."""
    given = defaults or {}
    return df.select(*((F.col(c) if c in df.columns else given.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in contract.items()))


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of several columns that df has, else null."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None))


def with_lineage(df: DataFrame, lineage: dict[str, dict]) -> DataFrame:
    """Puts each feature's kind, sources and temporal rule into its field's metadata, where it survives the plan."""
    return df.select(*(F.col(c).alias(c, metadata=lineage[c]) if c in lineage else F.col(c) for c in df.columns))
