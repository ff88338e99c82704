"""Predictions of rows by models that have not seen them, and boosters on what those predictions leave.

Folds are dealt by entity, from a digest of its name, or by year, each predicted from all years before it. There are as many
fits as folds; rows stay in Spark, and each row is scored once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import expr as X
from tidemark.ml.models import Features, Training, predict
from tidemark.operators import aggregates as A
from tidemark.operators import splits
from tidemark.operators.tables import stored


def fold_of(entity: str | Column, folds: int, seed: int = 7) -> Column:
    """0 to folds - 1, the same for all rows of an entity; rows without one are an entity of their own."""
    name = F.coalesce(A.c(entity).cast("string"), F.lit(""))
    mark = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), name)), 1, 8)
    return (F.conv(mark, 16, 10).cast("long") % folds).cast("int")


def out_of_fold_means(rows: DataFrame, by: list[str], entity: str, label: str, weight: str, folds: int = 5, seed: int = 7, out: str = "prediction", fold: str = "fold") -> DataFrame:
    """rows with their fold and the weighted mean label of their group over the other folds: the mean of all other folds'
    rows where the group has none there. Sums of all less those of a fold, so the table is read once for them and nothing is fitted."""
    numbered = rows.withColumn(fold, fold_of(entity, folds, seed))
    known = F.when(F.col(label).isNotNull(), F.col(weight))
    sums = numbered.groupBy(*by, fold).agg(F.sum(known * F.col(label)).alias("_s"), F.sum(known).alias("_w"))
    sums = stored(sums, "fold-sums")  # a row a group and fold
    spine = sums.select(*(F.col(k).alias(k) for k in by)).distinct().withColumn(fold, F.explode(F.array(*map(F.lit, range(folds)))))  # a row a group and fold
    null_safe = lambda a, b, keys: reduce(Column.__and__, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))
    cells = spine.join(sums, null_safe(spine, sums, [*by, fold]), "left").select(*(spine[k] for k in by), spine[fold], F.coalesce("_s", F.lit(0.0)).alias("_s"), F.coalesce("_w", F.lit(0.0)).alias("_w"))
    group, every = Window.partitionBy(*by), Window.partitionBy(fold)
    total = cells.agg(F.sum("_s").alias("_all_s"), F.sum("_w").alias("_all_w"))  # one row
    other = lambda c: F.sum(c).over(group) - F.col(c)
    rest = lambda c: F.col(f"_all{c}") - F.sum(c).over(every)
    means = cells.join(F.broadcast(total)).select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col(fold).alias("_fold"),
        F.coalesce(F.when(other("_w") > 1e-12, other("_s") / other("_w")), F.when(rest("_w") > 1e-12, rest("_s") / rest("_w"))).alias(out),
    )
    means = stored(means, "fold-means")  # so that Spark sees how small it is before it decides to move the rows
    same = numbered[fold] == means["_fold"]
    for i, k in enumerate(by):
        same &= numbered[k].eqNullSafe(means[f"_k{i}"])
    return numbered.join(means, same, "left").drop("_fold", *(f"_k{i}" for i in range(len(by))))


def _scored(rows: DataFrame, parts: list[tuple[int, Column, Column]], features: Features, estimators: dict, fold: str, training: Training) -> DataFrame:
    """Each part's rows (third) by models of other rows (second), a column for each of the estimators; together, stored."""
    found = []
    for number, seen, own in parts:
        held, others = rows.where(own), training.where(seen)
        for name, estimator in estimators.items():
            held = predict(others.fit(estimator), held, features, name).drop(*(f"{x}_missing" for x in features.numeric))
        found.append(held.withColumn(fold, F.lit(number)))
    return stored(reduce(DataFrame.unionByName, found), "out-of-fold")


def out_of_fold(rows: DataFrame, features: Features, entity: str, estimator, folds: int = 5, seed: int = 7, prediction: str = "prediction", fold: str = "fold") -> DataFrame:
    """All rows, each with a prediction from a model fitted on the other folds' entities, and its fold."""
    numbered = stored(rows.withColumn("_fold", fold_of(entity, folds, seed)), "folds")
    present = [r[0] for r in numbered.select("_fold").distinct().orderBy("_fold").collect()]  # a row a fold
    if len(present) < 2:
        raise ValueError("cross-fitting needs entities in two folds")
    parts = [(k, F.col("_fold") != k, F.col("_fold") == k) for k in present]
    return _scored(numbered, parts, features, {prediction: estimator}, fold, Training(numbered, features, [estimator], ("_fold",))).drop("_fold")


def rolling_out_of_fold(rows: DataFrame, features: Features, year: str, entity: str, estimator, folds: int = 3, prediction: str = "prediction", fold: str = "fold", training: Training | None = None) -> DataFrame:
    """The rows of the last years that have enough entities, each year predicted from all before it. Less than two such years
    are an error: a correction learned on one year alone says nothing of the next. For several estimators at once, give a dict by
    name of the column. ``training`` may be given if the rows are packed by year already."""
    found = splits.rolling_folds(rows, year, entity, folds)
    if len(found) < 2:
        raise ValueError("out-of-fold rows need two years with enough entities before them")
    estimators = estimator if isinstance(estimator, dict) else {prediction: estimator}
    training = training or Training(rows, features, list(estimators.values()), (year,))
    return _scored(rows, [(y, F.col(year) < y, F.col(year) == y) for y in found], features, estimators, fold, training)


def cap(rows: DataFrame, residual: str, weight: str, q: float = 0.9) -> DataFrame:
    """One row, ``cap``: the weighted q-quantile of the residuals' sizes, and never 0."""
    sized = rows.where(F.col(residual).isNotNull() & (F.col(weight) >= 0)).select(F.abs(residual).alias("_size"), F.col(weight).alias("_weight"))
    found = A.weighted_quantile(sized, "_size", "_weight", q, out="cap")
    return found.agg(F.greatest(F.max("cap"), F.lit(1e-9)).alias("cap")).select(F.coalesce("cap", F.lit(1e-9)).alias("cap"))


def booster(label: str, weight: str, rounds: int = 20, step: float = 0.1, least_rows: int = 80, seed: int = 7) -> GBTRegressor:
    """Shallow trees over large leaves: a correction that few rows can't move."""
    return GBTRegressor(
        featuresCol="features", labelCol=label, weightCol=weight, predictionCol="prediction", maxIter=rounds, stepSize=step, maxDepth=3,
        minInstancesPerNode=least_rows, subsamplingRate=0.85, seed=seed,
    )


def residual_booster(oof: DataFrame, features: Features, label: str, weight: str, prediction: str = "prediction", estimator=None) -> tuple[PipelineModel, Features, float]:
    """A booster on what the out-of-fold predictions leave, its features (the prediction among them) and the bound of its
    corrections."""
    rows = oof.withColumn("_residual", F.coalesce(F.col(label) - F.col(prediction), F.lit(0.0)))
    own = Features(tuple(dict.fromkeys((*features.numeric, "base_prediction"))), features.categorical)
    rows = rows.withColumnRenamed(prediction, "base_prediction")
    bound = cap(rows, "_residual", weight).first()["cap"]
    estimator = estimator or booster("_residual", weight)
    return Training(rows.where(F.col(weight) > 0), own, [estimator], apart=True).fit(estimator), own, bound


def boosted(df: DataFrame, model: PipelineModel, features: Features, bound: float, prediction: str = "prediction", least: float | None = None) -> DataFrame:
    """df, which has a prediction, with the bounded correction added to it; no less than ``least`` if that is given."""
    held = predict(model, df.withColumnRenamed(prediction, "base_prediction"), features, "_correction").drop(*(f"{x}_missing" for x in features.numeric))
    new = F.col("base_prediction") + X.clamp("_correction", -bound, bound)
    return held.withColumn(prediction, new if least is None else F.when(new.isNotNull(), F.greatest(F.lit(least), new))).drop("_correction")


def booster_gain(rows: DataFrame, features: Features, label: str, weight: str, year: str, entity: str, estimator, folds: int = 3, least: float | None = None) -> DataFrame:
    """One row: whether a booster on rolling out-of-fold residuals of the years before the last improves the last year, whose
    base predictions come from all earlier rows; its bound, rows and both errors."""
    last = rows.agg(F.max(year)).first()[0]
    early, late = rows.where(F.col(year) < last), rows.where(F.col(year) == last)
    training = Training(early, features, [estimator], (year,))
    oof = rolling_out_of_fold(early, features, year, entity, estimator, folds, training=training)
    model, own, bound = residual_booster(oof, features, label, weight)
    base = predict(training.fit(estimator), late, features)
    base = base.drop(*(f"{x}_missing" for x in features.numeric))
    both = boosted(base, model, own, bound, least=least)
    mae = lambda p: A.regression_metrics(label, p, weight)["mae"]
    return both.agg(
        F.lit(bound).alias("cap"), F.count("*").alias("rows"), mae("base_prediction").alias("mae"), mae("prediction").alias("boosted_mae"),
        F.max(F.abs(F.col("prediction") - F.col("base_prediction"))).alias("largest_correction"),
    ).withColumn("better", F.col("boosted_mae") < F.col("mae"))
