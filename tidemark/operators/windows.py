"""Window operators over ordered histories: as-of slopes, trailing measures, streaks, priors, sampling.

Histories are keyed by ``key`` and ordered by ``day``, an integer day number. Calendar ranges are RANGE frames on it.
Every operator reads the current and earlier rows only, so later rows never change a result. Where two rows of a key
share a day, RANGE frames see both; ``one_per_day`` collapses them first. One ordering serves all operators of a
key, so Spark needs a single exchange and sort for any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MONTH_DAYS = 30.4375


def ordered(key, day="day"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([day] if isinstance(day, str) else day))


def trailing(key, width: int, day="day", current: bool = True):
    """The days [day - width, day], or without the current one."""
    return ordered(key, day).rangeBetween(-width, 0 if current else -1)


def so_far(key, day="day"):
    return ordered(key, day).rowsBetween(Window.unboundedPreceding, 0)


def before(key, day="day"):
    return ordered(key, day).rowsBetween(Window.unboundedPreceding, -1)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_number(ts) -> Column:
    return F.datediff(_c(ts).cast("date"), F.lit("1970-01-01").cast("date"))


def one_per_day(df: DataFrame, key: str, day: str, tie: str) -> DataFrame:
    """The last row of each key and day, by ``tie``."""
    last = Window.partitionBy(key, day).orderBy(F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def lagged(x, key, day="day") -> Column:
    return F.lag(_c(x)).over(ordered(key, day))


def change(x, key, day="day") -> Column:
    return _c(x) - lagged(x, key, day)


def changed(x, key, day="day", eps: float = 1e-9) -> Column:
    """1 where this and the previous row have values that differ, else 0."""
    return F.coalesce((F.abs(change(x, key, day)) > eps).cast("int"), F.lit(0))


def running_sum(x, key, day="day") -> Column:
    return F.sum(_c(x)).over(so_far(key, day))


def running_mean(x, key, day="day") -> Column:
    return F.avg(_c(x)).over(so_far(key, day))


def running_max(x, key, day="day") -> Column:
    """Null on rows without a value."""
    return F.when(_c(x).isNotNull(), F.max(_c(x)).over(so_far(key, day)))


def recovery(x, key, day="day") -> Column:
    """How far x lies below its peak so far."""
    return running_max(x, key, day) - _c(x)


def ordinal(key, day="day") -> Column:
    return F.row_number().over(ordered(key, day))


def months_observed(key, day="day") -> Column:
    return (_c(day) - F.min(_c(day)).over(so_far(key, day))) / MONTH_DAYS


def worsened(x, key, day="day") -> Column:
    """1 if x rose since the previous row, 0 if not or unknown, null on a key's first row."""
    rise = F.coalesce((change(x, key, day) > 0).cast("int"), F.lit(0))
    return F.when(ordinal(key, day) > 1, rise)


def slope(x, key, width: int, day="day") -> Column:
    """Change a month since the earliest row with a value among the ``width`` days before this one."""
    w, x = trailing(key, width, day, current=False), _c(x)
    value = F.first(x, ignorenulls=True).over(w)
    at = F.first(F.when(x.isNotNull(), _c(day)), ignorenulls=True).over(w)
    return (x - value) / ((_c(day) - at) / MONTH_DAYS)


def acceleration(x, key, short: int, long: int, day="day") -> Column:
    return slope(x, key, short, day) - slope(x, key, long, day)


def trailing_count(event, key, width: int, day="day") -> Column:
    return F.sum(_c(event)).over(trailing(key, width, day))


def trailing_sum(x, key, width: int, day="day") -> Column:
    return F.sum(_c(x)).over(trailing(key, width, day))


def trailing_std(delta, key, width: int, day="day") -> Column:
    """Sample deviation of a column of changes; null below two values."""
    w, d = trailing(key, width, day), _c(delta)
    return F.when(F.count(d).over(w) >= 2, F.stddev_samp(d).over(w))


def depth(key, width: int, day="day") -> Column:
    return F.count(F.lit(1)).over(trailing(key, width, day))


def months_since(event, key, day="day") -> Column:
    """Months since the last row with the event, 0 on it, null before the first."""
    last = F.last(F.when(_c(event) == 1, _c(day)), ignorenulls=True).over(so_far(key, day))
    return (_c(day) - last) / MONTH_DAYS


def months_since_first(event, key, day="day") -> Column:
    """Months since the first row with the event; null before it, so no row tells that one will come."""
    first = F.min(F.when(_c(event) == 1, _c(day))).over(so_far(key, day))
    return (_c(day) - first) / MONTH_DAYS


def streak(df: DataFrame, x: str, key: str, out: str, day: str = "day", eps: float = 1e-9) -> DataFrame:
    """Adds the number of rises in a row: a value that does not rise resets it, a missing change holds it."""
    d = change(x, key, day)
    df = df.withColumn("_d", d).withColumn("_i", F.sum(F.when(F.col("_d") <= eps, 1).otherwise(0)).over(so_far(key, day)))
    inside = Window.partitionBy(key, "_i").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(F.col("_d") > eps, 1).otherwise(0)).over(inside)).drop("_d", "_i")


def revised(x, key, day="day") -> Column:
    """1 where x differs from the last value known before."""
    known = F.last(_c(x), ignorenulls=True).over(before(key, day))
    return F.coalesce((_c(x) != known).cast("int"), F.lit(0))


def change_from_known(x, key, day="day") -> Column:
    """The change since the last value known before; 0 without one."""
    known = F.last(_c(x), ignorenulls=True).over(before(key, day))
    return F.coalesce(_c(x) - known, F.lit(0.0))


def two_point_trend(x, key, width: int, day="day") -> Column:
    """Change a month between the first and last value of the trailing days; null below two values."""
    w, x = trailing(key, width, day), _c(x)
    at = F.when(x.isNotNull(), _c(day))
    a, b = F.first(x, ignorenulls=True).over(w), F.last(x, ignorenulls=True).over(w)
    first, last = F.first(at, ignorenulls=True).over(w), F.last(at, ignorenulls=True).over(w)
    return F.when((F.count(x).over(w) >= 2) & (last > first), (b - a) / ((last - first) / MONTH_DAYS))


def average_percent_rank(x, by=()) -> Column:
    """(rank + (ties - 1) / 2) / n over the rows with a value; null without one. Without ``by`` all rows meet in one
    task; prefer ``operators.ranks`` on large tables."""
    x = _c(x)
    has = x.isNotNull()
    whole = Window.partitionBy(*by, has)
    rank = F.rank().over(whole.orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, has, x))
    return F.when(has, (rank + (ties - 1) / 2) / F.count(F.lit(1)).over(whole))


def balanced_weight(key) -> Column:
    """1 / rows of the key, so that each key weighs 1. Compute it after every filter."""
    return 1.0 / F.count(F.lit(1)).over(Window.partitionBy(key))


def pick(df: DataFrame, by: list, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, key: str, day: str, tie: str) -> DataFrame:
    return pick(df, [key], [F.col(day).desc(), F.col(tie).desc()])


def quarter_last(df: DataFrame, key: str, date: str, tie: str) -> DataFrame:
    """The last row of each key and calendar quarter."""
    return pick(df, [F.col(key), F.year(date), F.quarter(date)], [F.col(date).desc(), F.col(tie).desc()])
