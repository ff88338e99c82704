"""Ranks and exact quantiles over whole tables or large groups, without bringing a table or a group to one task.

Distinct values are counted first (combined on the map side) and range-partitioned by group and value; what stands in
earlier partitions of a group comes from one row a partition and group. No task holds a group's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.tables import stored


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Whether rows of a and b agree in the named columns, nulls included."""
    return reduce(Column.__and__, (a[c].eqNullSafe(b[c]) for c in names), F.lit(True))


def before(values: DataFrame, x: str, sums: list[str], by: list[str] = ()) -> DataFrame:
    """values has one row for each group and value of x; adds, for each column s, ``_before_s``, its sum over the group's lesser
    values, and ``_total_s``, that over all.

    The ranges are stored with their numbers: rows and the ranges' totals read one and the same cut, whatever the plan.
    """
    by = list(by)
    parts = stored(values.repartitionByRange(*by, x).withColumn("_p", F.spark_partition_id()), "ranges")
    keys = [*by, "_p"]
    totals = parts.groupBy(*keys).agg(*(F.sum(s).alias(f"_all_{s}") for s in sums))
    # At most a row for each range, and one more for each group.
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        *(F.coalesce(F.sum(f"_all_{s}").over(earlier), F.lit(0)).alias(f"_outside_{s}") for s in sums),
        *(F.sum(f"_all_{s}").over(whole).alias(f"_total_{s}") for s in sums),
    )
    inside = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select("*", *(F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_inside_{s}") for s in sums))
    both = placed.join(totals, _same(placed, totals, keys))
    return both.select(
        *(placed[c] for c in values.columns),
        *((placed[f"_inside_{s}"] + totals[f"_outside_{s}"]).alias(f"_before_{s}") for s in sums),
        *(totals[f"_total_{s}"] for s in sums),
    )


def _at(q: float, x: str) -> Column:
    """As an aggregate over values with ``_n``, ``_before__n`` and ``_total__n``: the linearly interpolated quantile."""
    place = (F.col("_total__n") - 1) * F.lit(q)
    here = lambda i: F.max(F.when((F.col("_before__n") <= i) & (i < F.col("_before__n") + F.col("_n")), F.col(x)))
    low, high, part = here(F.floor(place)), here(F.ceil(place)), F.max(place - F.floor(place))
    return low * (1 - part) + high * part


def quantiles(df: DataFrame, x: str, qs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """by and the exact quantiles of x, linearly interpolated, by name. Nulls are dropped; a group of nulls has no row, and a
    table without values has nulls."""
    by = list(by)
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    placed = before(counts, x, ["_n"], by)
    return placed.groupBy(*by).agg(*(_at(q, x).alias(name) for name, q in qs.items()))


def weighted_quantile(values: DataFrame, x: str, q: float, by: list[str], out: str) -> DataFrame:
    """by and the least x whose running weight reaches q of the group's; without weight the plain quantile. values has one
    row for each group and value, with ``_w``, the sum of weights, and ``_n``, the number of rows."""
    by = list(by)
    placed = before(values, x, ["_w", "_n"], by)
    reached = F.min(F.when(F.col("_before__w") + F.col("_w") >= q * F.col("_total__w") - 1e-12, F.col(x)))
    return placed.groupBy(*by).agg(F.when(F.max("_total__w") > 0, reached).otherwise(_at(q, x)).alias(out))


def average_percent_rank(df: DataFrame, x: str, out: str, by: list[str] = ()) -> DataFrame:
    """Adds (rank + (ties - 1) / 2) / n of x among its values in the group, null where x is."""
    by = list(by)
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    placed = before(counts, x, ["_n"], by)
    rank = (F.col("_before__n") + 1 + (F.col("_n") - 1) / 2) / F.col("_total__n")
    ranks = placed.select(*(F.col(c).alias(f"_{c}") for c in (*by, x)), rank.alias("_rank"))
    same = reduce(Column.__and__, (df[c].eqNullSafe(ranks[f"_{c}"]) for c in (*by, x)))
    return df.join(ranks, same, "left").select(*(df[c] for c in df.columns), ranks["_rank"].alias(out))
