"""Audits: they report violations and never drop rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.expr import available


def counted(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows fail each check, in one pass; a null test does not fail."""
    return df.agg(F.count("*").alias("rows"), *(F.count(F.when(t, F.lit(1))).alias(k) for k, t in checks.items()))


def duplicated_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key comes more than once, all of them counted."""
    n = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicated_rows"))


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing), a row for each column of df."""
    one = df.agg(*(F.count(F.when(F.col(x).isNull(), 1)).alias(x) for x in df.columns))
    return one.unpivot([], df.columns, "column", "missing")


def conflicts(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, field, n_values, values) where rows of a key disagree; values in order, parted by ' | '."""
    long = df.select(*key, *(F.col(x).cast("string").alias(x) for x in fields)).unpivot(key, fields, "field", "value").where("value IS NOT NULL")
    n = long.groupBy(*key, "field").agg(F.countDistinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("value")), " | ").alias("values"))
    return n.where("n_values > 1")


def coalesced_parts(df: DataFrame, key: str, order: str, fields: list[str], sources: str) -> DataFrame:
    """One row a key: the last value of each field in order, and the distinct sources in order of their first row.
    Rows without a key pass through."""
    last = [F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias(x) for x in fields]
    listed = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, sources))), lambda s: s[sources])), " | ").alias(sources)
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(*last, listed)
    return keyed.unionByName(df.where(F.col(key).isNull()).select(key, *fields, sources))


def feature_audit(df: DataFrame, features: list[str], year: str, unsafe: tuple = (), least_share: float = 10.0, least_years: int = 2) -> DataFrame:
    """For each numeric feature: availability and zero share in per cent, distinct values, years with a value, availability
    by year, and whether to keep it, with the first reason against it.

    The table is made long once and summed by (feature, year, value-free) in one shuffle.
    """
    long = df.select(year, *(F.col(x).cast("double").alias(x) for x in features)).unpivot([year], features, "feature", "value")
    ok = available("value", "double")
    yearly = long.groupBy("feature", year).agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("have"), F.count(F.when(ok & (F.col("value") == 0), 1)).alias("zero"))
    distinct = long.where(ok).groupBy("feature").agg(F.countDistinct("value").alias("n_unique"))
    years = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(year).cast("string").alias("y"), F.round(100 * F.col("have") / F.col("n"), 2).alias("share")))))
    total = yearly.groupBy("feature").agg(
        (100 * F.sum("have") / F.sum("n")).alias("availability"),
        (100 * F.sum("zero") / F.nullif(F.sum("have"), F.lit(0))).alias("zero_share"),
        F.count(F.when(F.col("have") > 0, 1)).alias("years"),
        years.alias("by_year"),
    )
    out = total.join(distinct, "feature", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    reason = (
        F.when(F.col("availability") < least_share, "low availability").when(F.col("n_unique") <= 1, "constant")
        .when(F.col("years") < least_years, "few years").when(F.col("feature").isin(*unsafe) if unsafe else F.lit(False), "not as-of safe")
    )
    return out.withColumn("reason", reason).withColumn("keep", F.col("reason").isNull())


def require_disjoint(features: list[str], forbidden: list[str]) -> None:
    """Raises if a column that tells the outcome is among the features."""
    if leak := sorted(set(features) & set(forbidden)):
        raise ValueError(f"features that tell the outcome: {leak}")
