"""Replay of many cut-offs: what was known of each entity at each of them, what was said, and what came.

Cut-offs are put among an entity's rows as rows of their own, one a cut-off that falls into its life, and one window carries the
state from row to row: no row is paired with a cut-off, and a history of any length is read in order, once each way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import aggregates as A


def replay(history: DataFrame, cutoffs: list, key: str, day: str, value: str, carried: tuple[str, ...] = (), end: str | None = None, horizon: int | None = None) -> DataFrame:
    """(key, cutoff, n, total, last_day, known, carried..., next_day, actual): an entity's rows up to and on each cut-off from its
    first row on, and the first row with a value after it, within ``horizon`` days if that is given.

    ``known`` is the last value that isn't null, as are the carried columns; ``n`` and ``total`` are of values. With ``end``, a
    column of the day an entity ended, it has no cut-offs from then on. Rows without a day or key are left out. Rows of one day
    count all; the last among them is the greatest by value.
    """
    cuts = F.array(*(F.lit(c).cast("date") for c in sorted(set(cutoffs))))
    known = history.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    rows = known.select(key, F.col(day).cast("date").alias("_day"), F.lit(0).alias("_mark"), F.col(value).cast("double").alias("_value"), *carried)
    over = F.max(F.col(end).cast("date")) if end else F.lit(None).cast("date")
    lives = known.groupBy(key).agg(F.min(F.col(day).cast("date")).alias("_first"), over.alias("_end"))
    inside = lambda c: (c >= F.col("_first")) & (F.col("_end").isNull() | (c < F.col("_end")))
    marks = lives.select(key, F.explode(F.filter(cuts, inside)).alias("_day"), F.lit(1).alias("_mark"), F.lit(None).cast("double").alias("_value"), *(F.lit(None).cast(history.schema[c].dataType).alias(c) for c in carried))
    order = Window.partitionBy(key).orderBy("_day", "_mark", "_value")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # What comes later is what came before in the opposite order: a frame that only grows costs one step a row.
    later = Window.partitionBy(key).orderBy(F.desc("_day"), F.desc("_mark"), F.desc("_value")).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("_value").isNotNull(), F.struct(F.col("_day").alias("day"), F.col("_value").alias("value")))
    both = rows.unionByName(marks).select(
        key, "_day", "_mark", F.count("_value").over(so_far).alias("n"), F.sum("_value").over(so_far).alias("total"),
        F.last(F.when(F.col("_mark") == 0, F.col("_day")), True).over(so_far).alias("last_day"), F.last("_value", True).over(so_far).alias("known"),
        *(F.last(c, True).over(so_far).alias(c) for c in carried), F.last(seen, True).over(later).alias("_next"),
    )
    within = F.lit(True) if horizon is None else F.datediff("_next.day", "_day") <= horizon
    return both.where("_mark = 1").select(
        key, F.col("_day").alias("cutoff"), "n", "total", "last_day", "known", *carried, F.when(within, F.col("_next.day")).alias("next_day"), F.when(within, F.col("_next.value")).alias("actual"),
    )


def predictions(states: DataFrame, key: str, predicted: Column, least: float | None = None, evidence: tuple[str, ...] = ("known", "total", "last_day")) -> DataFrame:
    """What a backtest writes: prediction, actual value, error, accuracy in per cent, and how much of the evidence was there."""
    said = F.when(predicted.isNotNull(), F.greatest(F.lit(least), predicted)) if least is not None else predicted
    rows = states.where(F.col("actual").isNotNull()).withColumn("predicted", said)
    accuracy = F.greatest(F.lit(0.0), 100 - F.abs(F.col("predicted") - F.col("actual")) / F.greatest(F.abs("actual"), F.lit(1.0)) * 100)
    there = sum((F.col(c).isNotNull().cast("double") for c in evidence), F.lit(0.0)) / len(evidence) * 100
    return rows.select(key, "cutoff", "predicted", "actual", (F.col("predicted") - F.col("actual")).alias("error"), accuracy.alias("accuracy"), there.alias("confidence"))


def report(written: DataFrame, elevated: float) -> DataFrame:
    """A row a cut-off: errors, mean accuracy, and how well predictions of ``elevated`` or more say actual ones."""
    yes = lambda x: F.col(x) >= elevated
    metrics = A.regression_metrics("actual", "predicted")
    table = {"true_positive": yes("actual") & yes("predicted"), "false_positive": ~yes("actual") & yes("predicted"), "false_negative": yes("actual") & ~yes("predicted"), "true_negative": ~yes("actual") & ~yes("predicted")}
    found = written.groupBy("cutoff").agg(*(metrics[m].alias(m) for m in ("mae", "rmse", "r2", "rows")), F.avg("accuracy").alias("accuracy"), *(F.count_if(x).alias(k) for k, x in table.items()))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col("true_positive"), F.col(a) + F.col(b)), F.lit(0.0))
    return found.withColumns({"precision": ratio("true_positive", "false_positive"), "recall": ratio("true_positive", "false_negative")})
