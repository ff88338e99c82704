"""Temporal splits and sampling cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.ranks import before


def by_date(df: DataFrame, date: str, test_share: float) -> tuple[DataFrame, DataFrame]:
    """Rows before the cut-off date, and from it on. The cut-off is the k-th distinct date; one date gives no split."""
    dates = df.select(date).where(F.col(date).isNotNull()).distinct().withColumn("_n", F.lit(1))
    placed = before(dates, date, ["_n"])
    total = placed.select("_total__n").first()
    if total is None or total[0] < 2:
        raise ValueError("a temporal split needs two dates")
    k = min(total[0] - 1, max(1, int(total[0] * (1 - test_share))))
    cut = placed.where(F.col("_before__n") == k).first()[date]
    return df.where(F.col(date) < F.lit(cut)), df.where(F.col(date) >= F.lit(cut))


def by_rows(df: DataFrame, order: list[str], test_share: float) -> tuple[DataFrame, DataFrame]:
    """The first rows in the given order, and the last share of them. The order must tell rows apart: rows that tie go to the
    same side. Only the row at the cut is looked for, in ranges of the order, so no task sorts the table."""
    place = F.struct(*order)
    counts = df.groupBy(place.alias("_place")).agg(F.count("*").alias("_n"))
    total = df.count()
    cut = total - int(total * test_share)
    placed = before(counts, "_place", ["_n"]).where(F.col("_before__n") >= cut)
    edge = F.broadcast(placed.agg(F.min("_place").alias("_edge")))  # one row
    late = F.coalesce(place >= F.col("_edge"), F.lit(False))
    both = df.join(edge)
    return both.where(~late).drop("_edge"), both.where(late).drop("_edge")


def years(df: DataFrame, year: str, first: int, last: int) -> DataFrame:
    return df.where(F.col(year).between(first, last))


def rolling_folds(df: DataFrame, year: str, entity: str, folds: int = 3, least_train: int = 10, least_test: int = 3) -> list[int]:
    """The last years that have enough entities, and enough before them."""
    n = df.groupBy(year).agg(F.countDistinct(entity).alias("n")).orderBy(year)
    rows = n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(year).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a year
    return [r[year] for r in rows.where((F.col("n") >= least_test) & (F.col("before") >= least_train)).collect()][-folds:]


def cutoff_rows(history: DataFrame, ends: DataFrame, key: str, date: str, start: str, end: str) -> DataFrame:
    """For each entity that ended, its last row at least max(90, life / 4) days before the end, where life counts as 120
    days or more."""
    life = F.greatest(F.lit(120), F.datediff(end, start))
    gap = F.greatest(F.lit(90), F.floor(life / 4).cast("int"))
    met = history.join(ends.select(key, start, end), key).where(F.col(date) <= F.date_sub(F.col(end).cast("date"), gap))
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
