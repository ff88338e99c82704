"""Aggregates: exact quantiles and moments, weighted metrics, residual calibration, shrinkage, paired bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import ranks


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quantile(x, q: float) -> Column:
    """Exact, linearly interpolated, nulls dropped; null of nothing. It holds a group's distinct values in one task: for
    groups of bounded size. ``ranks.quantiles`` is for tables and large groups."""
    return F.percentile(c(x), F.lit(q))


def skewness(x) -> Column:
    """Bias-corrected: the population skewness times sqrt(n(n-1)) / (n-2); null below three values."""
    n = F.count(c(x)).cast("double")
    return F.when(n > 2, F.skewness(c(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def count_where(test) -> Column:
    return F.count(F.when(c(test), F.lit(1)))


def distribution(df: DataFrame, x: str) -> DataFrame:
    """n, min, max, mean, std, skew and seven quantiles of a column."""
    qs = {f"p{round(q * 100):02d}": q for q in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)}
    moments = df.agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"), skewness(x).alias("skew"),
    )
    return moments.join(F.broadcast(ranks.quantiles(df, x, qs)))  # one row each


def outliers(df: DataFrame, x: str, reach: float = 1.5) -> DataFrame:
    """How many values lie strictly outside the quartiles by more than reach times their distance."""
    q = ranks.quantiles(df, x, {"q1": 0.25, "q3": 0.75})
    width = F.col("q3") - F.col("q1")
    out = (F.col(x) < F.col("q1") - reach * width) | (F.col(x) > F.col("q3") + reach * width)
    return df.join(F.broadcast(q)).agg(count_where(out).alias("outliers"), F.count(x).alias("n"))  # q is one row


def regression_metrics(y, p, w=None) -> dict[str, Column]:
    """Weighted MAE, RMSE, R2 and MAPE (over |y| >= 1) as aggregates over rows with both values."""
    y, p = c(y), c(p)
    ok = y.isNotNull() & p.isNotNull()
    w = F.when(ok, c(w) if w is not None else F.lit(1.0))
    e = F.when(ok, y - p)
    total = F.sum(w)
    mean_square = F.sum(w * e * e)
    spread = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / total
    big = ok & (F.abs(y) >= 1)
    return {
        "mae": F.sum(w * F.abs(e)) / total,
        "rmse": F.sqrt(mean_square / total),
        "r2": F.when((F.count(e) >= 2) & (spread > 0), 1 - mean_square / spread),
        "mape": 100 * F.sum(F.when(big, w * F.abs(e / y))) / F.sum(F.when(big, w)),
        "rows": F.count(e),
    }


def by_level(df: DataFrame, level: str, levels: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Metrics of each level; levels without rows stand with ``available`` false."""
    spine = df.sparkSession.createDataFrame([(x,) for x in levels], f"{level} string")
    found = df.groupBy(level).agg(*(m.alias(k) for k, m in metrics.items()))
    return spine.join(found, level, "left").withColumn("available", F.coalesce(F.col("rows") > 0, F.lit(False))).withColumn("rows", F.coalesce("rows", F.lit(0)))


def macro_average(by_levels: DataFrame, metrics: list[str]) -> DataFrame:
    """The plain mean over the levels that are available."""
    return by_levels.where("available").agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("levels"))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list[str], w: Column | None = None) -> DataFrame:
    """The whole label x label table with weighted counts, zeros included."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{actual} string, {predicted} string")
    found = df.groupBy(actual, predicted).agg(F.sum(w if w is not None else F.lit(1.0)).alias("weight"))
    return cells.join(found, [actual, predicted], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def classification_metrics(table: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1 of a confusion table; a division by zero counts as 0."""
    hit = F.when(F.col(actual) == F.col(predicted), F.col("weight")).otherwise(0.0)
    a = table.groupBy(F.col(actual).alias("label")).agg(F.sum("weight").alias("is"), F.sum(hit).alias("tp"))
    b = table.groupBy(F.col(predicted).alias("label")).agg(F.sum("weight").alias("said"))
    per = a.join(b, "label")
    p, r = (F.coalesce(F.try_divide("tp", x), F.lit(0.0)) for x in ("said", "is"))
    per = per.withColumn("p", p).withColumn("r", r).withColumn("f", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return per.agg(
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("is")), F.lit(0.0)).alias("accuracy"),
        F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"),
    )


def weighted_quantile(df: DataFrame, x: str, w: str, q: float, by: list[str] = (), out: str = "value") -> DataFrame:
    """The least value whose running weight reaches q of the total; without weight the plain quantile. Equal values are
    summed first, on the map side."""
    return ranks.weighted_quantile(weighed(df, x, w, by), x, q, by, out)


def weighed(df: DataFrame, x: str, w: str, by: list[str] = ()) -> DataFrame:
    """One row for each group and value of x, with the sum of weights and the number of rows."""
    return df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.sum(w).alias("_w"), F.count("*").alias("_n"))


def _coarser(values: DataFrame, x: str, by: list[str]) -> DataFrame:
    return values.groupBy(*by, x).agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"))


def bin_edges(df: DataFrame, x: str, bins: int = 5) -> list[float]:
    """Inner edges: distinct quantiles without the outermost; the median alone if too few differ."""
    wanted = {f"q{i}": i / bins for i in range(bins + 1)} | {"middle": 0.5}
    q = ranks.quantiles(df, x, wanted).first().asDict()
    middle = q.pop("middle")
    if middle is None:
        return []
    edges = sorted(set(q.values()))
    return edges[1:-1] if len(edges) >= 3 else [middle]


def bin_number(x, edges: list[float]) -> Column:
    """How many inner edges x reaches, so bins are closed on the left."""
    return F.when(c(x).isNotNull(), sum((F.when(c(x) >= e, 1).otherwise(0) for e in edges), F.lit(0)))


def calibrated(df: DataFrame, x: str, residual: str, stage: str, w: str, bins: int = 5, least_rows: int = 20) -> DataFrame:
    """Adds ``bin`` and ``correction``: the weighted median residual of (stage, bin) if it has least_rows rows, else of
    the bin, else of all."""
    rows = df.withColumn("bin", bin_number(x, bin_edges(df, x, bins)))
    # All three levels come from one sum of the rows by stage, bin and value.
    values = weighed(rows, residual, w, [stage, "bin"])
    fine = ranks.weighted_quantile(values, residual, 0.5, [stage, "bin"], "_fine").join(values.groupBy(stage, "bin").agg(F.sum("_n").alias("_rows")), [stage, "bin"])
    coarse = ranks.weighted_quantile(_coarser(values, residual, ["bin"]), residual, 0.5, ["bin"], "_coarse")
    overall = ranks.weighted_quantile(_coarser(values, residual, []), residual, 0.5, [], "_overall")
    out = rows.join(F.broadcast(fine), [stage, "bin"], "left").join(F.broadcast(coarse), "bin", "left").join(F.broadcast(overall))  # bins x stages rows
    return out.withColumn("correction", F.coalesce(F.when(F.col("_rows") >= least_rows, F.col("_fine")), "_coarse", "_overall")).drop("_fine", "_rows", "_coarse", "_overall")


def shrunk_levels(df: DataFrame, residual: str, stage: str, w: str, strength: float = 40.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stage, bin, correction), (bin, correction) and the overall correction of rows that have a bin: weighted median
    residuals of bins shrunk to the overall one, and of stages in bins to those, by weight / (weight + strength)."""
    values = weighed(df, residual, w, [stage, "bin"])
    by_bin = _coarser(values, residual, ["bin"])
    overall = ranks.weighted_quantile(_coarser(values, residual, []), residual, 0.5, [], "_o")
    weight = lambda v, *by: v.groupBy(*by).agg(F.sum("_w").alias("_w"))
    coarse = ranks.weighted_quantile(by_bin, residual, 0.5, ["bin"], "_m").join(weight(by_bin, "bin"), "bin").join(F.broadcast(overall))  # one row
    a = F.col("_w") / (F.col("_w") + strength)
    coarse = coarse.select("bin", (a * F.col("_m") + (1 - a) * F.col("_o")).alias("_coarse"))
    fine = ranks.weighted_quantile(values, residual, 0.5, [stage, "bin"], "_m").join(weight(values, stage, "bin"), [stage, "bin"]).join(coarse, "bin")
    fine = fine.select(stage, "bin", (a * F.col("_m") + (1 - a) * F.col("_coarse")).alias("correction"))
    return fine, coarse.withColumnRenamed("_coarse", "correction"), overall


def shrunk_calibration(df: DataFrame, x: str, residual: str, stage: str, w: str, bins: int = 5, strength: float = 40.0) -> DataFrame:
    """(stage, bin, correction) over bins of x, see ``shrunk_levels``."""
    return shrunk_levels(df.withColumn("bin", bin_number(x, bin_edges(df, x, bins))), residual, stage, w, strength)[0]


def robust_weight(df: DataFrame, x: str, out: str = "weight") -> DataFrame:
    """Weights that fall with the distance from the median in interquartile ranges, within [0.25, 1]."""
    q = ranks.quantiles(df, x, {"_m": 0.5, "_a": 0.25, "_b": 0.75}).select("_m", (F.col("_b") - F.col("_a")).alias("_r"))
    far = F.abs(F.col(x) - F.col("_m")) / F.greatest(F.col("_r"), F.lit(1e-9))
    return df.join(F.broadcast(q)).withColumn(out, F.greatest(F.lit(0.25), F.least(F.lit(1.0), 1 / (1 + far)))).drop("_m", "_r")  # q is one row


def interval_coverage(actual, low, high) -> Column:
    return F.avg(c(actual).between(c(low), c(high)).cast("int")) * 100


def widening_factor(df: DataFrame, actual: str, low: str, mid: str, high: str, nominal: float = 80.0, ladder=(1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0)) -> DataFrame:
    """The first factor of the ladder whose widened intervals cover nominal - 2 per cent; else the last."""
    tests = [
        interval_coverage(actual, c(mid) - (c(mid) - c(low)) * s, c(mid) + (c(high) - c(mid)) * s).alias(f"_{i}") for i, s in enumerate(ladder)
    ]
    found = F.coalesce(*(F.when(F.col(f"_{i}") >= nominal - 2, F.lit(float(s))) for i, s in enumerate(ladder)), F.lit(float(ladder[-1])))
    return df.agg(*tests).select(found.alias("factor"))


def best(df: DataFrame, name: str, score: str, order: str) -> DataFrame:
    """The name with the least score, the first in order on ties."""
    return df.agg(F.min_by(name, F.struct(score, order)).alias(name), F.min(score).alias(score))


def paired_bootstrap(df: DataFrame, entity: str, base_error: str, new_error: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Confidence interval of the improvement in per cent when whole entities are drawn again.

    Each entity's weight in a draw is a Poisson(1) count from 40 bits of the MD5 of (seed, entity, draw), the usual form of
    the bootstrap for data that is spread out: no list of entities is gathered, and any engine finds the same counts again.
    """
    per = df.groupBy(entity).agg(F.avg(base_error).alias("_b"), F.avg(new_error).alias("_n"))
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(entity).cast("string"), F.col("draw").cast("string")))
    # The Poisson(1) distribution function up to 7, more has a probability of 1e-6: as the least number of 40 bits whose
    # middle lies beyond it, in hexadecimal, so that digests are compared as they stand.
    times, p, total = F.lit(8), 0.36787944117144233, 0.0
    steps = []
    for k in range(8):
        total += p
        steps.append(f"{int(total * (1 << 40) - 0.5) + 1:010x}")
        p /= k + 1
    for k, least in reversed(list(enumerate(steps))):
        times = F.when(F.col("_mark") < least, k).otherwise(times)
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_mark", mark).withColumn("_k", times)
    sums = drawn.groupBy("draw").agg(F.sum(F.col("_k") * F.col("_b")).alias("b"), F.sum(F.col("_k") * F.col("_n")).alias("n"))
    gain = sums.withColumn("gain", 100 * F.try_divide(F.col("b") - F.col("n"), F.col("b")))
    return gain.agg(F.avg("gain").alias("mean_gain"), quantile("gain", 0.025).alias("low"), quantile("gain", 0.975).alias("high"), F.avg((F.col("gain") > 0).cast("double")).alias("p_better"), F.count("*").alias("draws"))
