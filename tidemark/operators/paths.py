"""The path of an entity up to each of its rows, and rates in per cent of its own size.

All features read the current and earlier rows of a key, under one partitioning and order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import expr as X
from tidemark.operators import windows as W

#: What ``path_features`` adds.
PATH = (
    "observations_seen", "months_observed", "cost_revision_count", "schedule_revision_count", "abs_cost_revision_pct", "max_escalation", "escalation_recovery",
    "max_slippage", "slippage_recovery", "slippage_positive_share", "escalation_positive_share", "escalation_worsening_share", "slippage_worsening_share",
    "months_since_first_cost_revision", "months_since_first_schedule_revision",
)


def path_features(df: DataFrame, key: str, cost: str, escalation: str, slippage: str, day: str = "day") -> DataFrame:
    """Adds the columns of PATH, one row a key and day. A revision is a change from the row before where both have a value.
    Months since the first revision are -1 on rows before it: a row doesn't know that one will come."""
    positive = lambda x: F.when(F.col(x).isNotNull(), (F.col(x) > 0).cast("double"))
    earlier = W.lagged(cost, key, day)
    share = F.abs(F.col(cost) - earlier) / F.nullif(F.abs(earlier), F.lit(0.0)) * 100
    parts = df.withColumns(
        {
            "_cost_revised": W.changed(cost, key, day), "_schedule_revised": W.changed(slippage, key, day), "_share": F.coalesce(share, F.lit(0.0)),
            "_escalation_worse": W.worsened(escalation, key, day), "_slippage_worse": W.worsened(slippage, key, day),
        }
    )
    first = lambda event: F.coalesce(W.months_since_first(event, key, day), F.lit(-1.0))
    found = (
        W.ordinal(key, day), W.months_observed(key, day), W.running_sum("_cost_revised", key, day), W.running_sum("_schedule_revised", key, day), W.running_sum("_share", key, day),
        W.running_max(escalation, key, day), W.recovery(escalation, key, day), W.running_max(slippage, key, day), W.recovery(slippage, key, day),
        W.running_mean(positive(slippage), key, day), W.running_mean(positive(escalation), key, day), W.running_mean("_escalation_worse", key, day), W.running_mean("_slippage_worse", key, day),
        first("_cost_revised"), first("_schedule_revised"),
    )
    return parts.withColumns(dict(zip(PATH, found, strict=True))).drop("_cost_revised", "_schedule_revised", "_share", "_escalation_worse", "_slippage_worse")


def scaled(part: str, whole: str) -> Column:
    """part in per cent of a positive whole."""
    return X.ratio(part, whole) * 100


def scaled_rates(
    df: DataFrame, key: str, approved: str, revised: str, spent: str, slippage: str, planned_days: str, expected: str, day: str = "day", widths: tuple[int, int, int] = (93, 186, 366)
) -> DataFrame:
    """Rates of cost and spending in per cent of the approved amount and of slippage in per cent of the planned time: change a
    month over three widths, acceleration, size of revisions over the longest width, rises in a row, and how far spending
    runs ahead of expected progress."""
    short, middle, long = widths
    share = {"cost_pct": X.pct_change(approved, revised), "spend_pct": scaled(spent, approved), "slip_pct": scaled(slippage, planned_days)}
    df = df.withColumns({k: v for k, v in share.items()})
    for x in share:
        df = df.withColumns({f"{x}_rate_{n}": W.slope(x, key, w, day) for n, w in (("short", short), ("middle", middle), ("long", long))})
        df = df.withColumn(f"{x}_acceleration", F.col(f"{x}_rate_short") - F.col(f"{x}_rate_middle"))
    for x in ("cost_pct", "slip_pct"):
        df = df.withColumn("_moved", F.abs(W.change(x, key, day))).withColumn(f"{x}_revised_by", W.trailing_sum("_moved", key, long, day)).drop("_moved")
        df = W.streak(df, x, key, f"{x}_streak", day)
    return df.withColumn("spend_ahead", F.col("spend_pct") - F.col(expected))
