"""Training over time: guarded windows, rolling folds, specialists, corrections, feature groups, promotion.

Every comparison trains on earlier years and scores on a later one. Loops run over years, stages or feature groups, of
which there are few; rows stay in Spark.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import expr as X
from tidemark.ml.models import Features, families, fit, predict, prepared, risk_classifier, selected, stages
from tidemark.operators import aggregates as A
from tidemark.operators import audits, splits

_SCORES = ("mae", "rmse", "r2", "rows")


def huber(label: str, weight: str) -> LinearRegression:
    """A linear model that large errors pull on less; Spark's trees know no such loss."""
    return LinearRegression(featuresCol="features", labelCol=label, weightCol=weight, loss="huber", epsilon=1.35, regParam=0.01, maxIter=100)


def scores(held: DataFrame, label: str, weight: str, prediction: str = "prediction") -> dict:
    row = held.agg(*(v.alias(k) for k, v in A.regression_metrics(label, prediction, weight).items())).first()
    return {k: row[k] for k in _SCORES}


def _linear(label: str, weight: str):
    return families(label, weight)["linear"]


def _years(rows: DataFrame, year: str) -> list[int]:
    return [r[0] for r in rows.select(year).where(F.col(year).isNotNull()).distinct().orderBy(year).collect()]  # one a year


# Validation over time


def expanding_baseline(rows: DataFrame, year: str, label: str) -> DataFrame:
    """(year, mae, n): each year's values against the mean of all earlier years. The first year has none."""
    sums = rows.groupBy(year).agg(F.sum(label).alias("_total"), F.count(label).alias("_n"))
    earlier = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, -1)  # one row a year
    prior = sums.select(year, (F.sum("_total").over(earlier) / F.sum("_n").over(earlier)).alias("_prior")).where("_prior IS NOT NULL")
    return rows.join(F.broadcast(prior), year).groupBy(year).agg(F.avg(F.abs(F.col(label) - F.col("_prior"))).alias("mae"), F.count(label).alias("n"))


def rolling_validation(rows: DataFrame, features: Features, label: str, weight: str, year: str, entity: str, folds: int = 3, estimator=None) -> DataFrame:
    """(fold, mae, rmse, r2, rows) of the last years that have enough entities, each predicted from all years before it."""
    out = []
    for fold in splits.rolling_folds(rows, year, entity, folds):
        model = fit(rows.where(F.col(year) < fold), features, estimator or _linear(label, weight))
        out.append((fold, *scores(predict(model, rows.where(F.col(year) == fold), features), label, weight).values()))
    return rows.sparkSession.createDataFrame(out, "fold int, mae double, rmse double, r2 double, rows long")


def _last_year(rows: DataFrame, year: str) -> tuple[DataFrame, DataFrame, int]:
    years = _years(rows, year)
    if len(years) < 2:
        raise ValueError("a later year to score on is missing")
    return rows.where(F.col(year) < years[-1]), rows.where(F.col(year) == years[-1]), years[-1]


def group_selection(rows: DataFrame, features: Features, label: str, weight: str, year: str, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """(variant, mae, chosen): features without each group, all of them, and without those groups whose absence alone makes
    the last year no worse. The variant of least error is chosen, the one with more features on ties."""
    early, late, _ = _last_year(rows, year)

    def error(own: Features) -> float:
        return scores(predict(fit(early, own, _linear(label, weight)), late, own), label, weight)["mae"]

    found = {"all": error(features)}
    for name, gone in groups.items():
        found[f"without {name}"] = error(features.without(*gone))
    useless = [n for n in groups if found[f"without {n}"] <= found["all"]]
    kept = features.without(*(x for n in useless for x in groups[n]))
    if len(useless) > 1 and (kept.numeric or kept.categorical):
        found["without " + ", ".join(useless)] = error(kept)
    best = min(found, key=found.get)  # the first in order on ties
    return rows.sparkSession.createDataFrame([(k, v, k == best) for k, v in found.items()], "variant string, mae double, chosen boolean")


def entities_by_stage(rows: DataFrame, year: str, entity: str, stage: str) -> DataFrame:
    """(stage, train_entities, test_entities): distinct entities of each stage before the last year and in it."""
    last = rows.agg(F.max(year)).first()[0]
    one = F.when(F.col(year) < last, F.col(entity)), F.when(F.col(year) == last, F.col(entity))
    return rows.groupBy(stage).agg(F.countDistinct(one[0]).alias("train_entities"), F.countDistinct(one[1]).alias("test_entities"))


def stage_specialists(rows: DataFrame, features: Features, label: str, weight: str, year: str, entity: str, stage: str, least_train: int = 10, least_test: int = 2) -> DataFrame:
    """(stage, train_entities, test_entities, mae, global_mae): a model for each stage beside one for all, scored on the same
    rows of the last year. A stage with too few entities has no model, and a null mae."""
    early, late, _ = _last_year(rows, year)
    everyone = predict(fit(early, features, _linear(label, weight)), late, features)
    sizes = entities_by_stage(rows, year, entity, stage).collect()  # a row a stage
    before, after = {r[stage]: r["train_entities"] for r in sizes}, {r[stage]: r["test_entities"] for r in sizes}
    overall = {r[stage]: r["mae"] for r in everyone.groupBy(stage).agg(A.regression_metrics(label, "prediction", weight)["mae"].alias("mae")).collect()}
    out = []
    for s in sorted({*before, *after}, key=lambda x: (x is None, x)):
        own, error = F.col(stage).eqNullSafe(F.lit(s)), None
        if before.get(s, 0) >= least_train and after.get(s, 0) >= least_test:
            error = scores(predict(fit(early.where(own), features, _linear(label, weight)), late.where(own), features), label, weight)["mae"]
        out.append((s, before.get(s, 0), after.get(s, 0), error, overall.get(s)))
    return rows.sparkSession.createDataFrame(out, "stage string, train_entities long, test_entities long, mae double, global_mae double")


def corrections(rows: DataFrame, sector: str, residual: Column, strength: float = 5.0) -> DataFrame:
    """(sector, correction): mean residuals shrunk towards 0 for small sectors."""
    n = F.count(residual)
    return rows.groupBy(sector).agg((F.avg(residual) * n / (n + strength)).alias("correction"))


def corrected(held: DataFrame, table: DataFrame, sector: str, prediction: str = "prediction") -> DataFrame:
    """held with the sector's correction added; a sector without one keeps its prediction."""
    own = table.select(F.col(sector).alias("_sector"), "correction")
    both = held.join(F.broadcast(own), F.col(sector).eqNullSafe(F.col("_sector")), "left")  # a row a sector
    return both.withColumn(prediction, F.col(prediction) + F.coalesce("correction", F.lit(0.0))).drop("_sector", "correction")


def sector_correction(rows: DataFrame, features: Features, label: str, weight: str, year: str, sector: str) -> DataFrame:
    """One row: whether corrections learned on the last year but one improve the last. The model under the corrections has
    not seen the year they are learned on, nor the model under test the year it is scored on."""
    years = _years(rows, year)
    if len(years) < 3:
        raise ValueError("a nested correction needs three years")
    learned, checked = years[-2], years[-1]

    def held(y: int) -> DataFrame:
        return predict(fit(rows.where(F.col(year) < y), features, _linear(label, weight)), rows.where(F.col(year) == y), features)

    table = corrections(held(learned), sector, F.col(label) - F.col("prediction"))
    last = held(checked)
    plain, new = scores(last, label, weight)["mae"], scores(corrected(last, table, sector), label, weight)["mae"]
    return rows.sparkSession.createDataFrame([(learned, checked, plain, new, new < plain)], "correction_year int, validation_year int, mae double, corrected_mae double, enabled boolean")


def targets_compared(rows: DataFrame, features: Features, label: str, current: str, weight: str, year: str) -> DataFrame:
    """(target, mae, rmse, r2, rows) on the last year of models of the value itself, of what is left beyond the current
    value, of the value's signed logarithm, and with Huber's loss; all scored on the value."""
    early, late, _ = _last_year(rows, year)
    made = {
        "direct": (F.col(label), F.col("prediction"), None),
        "residual": (F.col(label) - F.col(current), F.col(current) + F.col("prediction"), None),
        "signed log": (X.signed_log(label), X.signed_exp(X.clamp("prediction", -30.0, 30.0)), None),
        "huber": (F.col(label), F.col("prediction"), huber("_target", weight)),
    }
    # The features are the same for all targets, so what prepares them is fitted once.
    before = Pipeline(stages=stages(features)).fit(prepared(early, features))
    out = []
    for name, (target, back, estimator) in made.items():
        used = before.transform(prepared(early.withColumn("_target", target), features)).select("features", "_target", weight)
        model = PipelineModel([*before.stages, (estimator or _linear("_target", weight)).fit(used)])
        found = scores(predict(model, late, features).withColumn("prediction", back), label, weight)
        out.append((name, *found.values()))
    return rows.sparkSession.createDataFrame(out, "target string, mae double, rmse double, r2 double, rows long")


# Risk and survival


def classify(train: DataFrame, features: Features, label: str, classes: int):
    """A function that adds ``prediction``: a balanced forest, or the only class there is."""
    seen = [r[0] for r in train.select(label).where(F.col(label).isNotNull()).distinct().limit(2).collect()]
    if not seen:
        raise ValueError(f"no row has {label}")
    if len(seen) == 1:
        return lambda df: df.withColumn("prediction", F.lit(float(seen[0])))
    model = risk_classifier(train.where(F.col(label).isNotNull()), features, label, classes)
    return lambda df: predict(model, df, features).drop("probability")


def completion_by_year(model: PipelineModel, df: DataFrame, features: Features, start: str, last_year: int) -> DataFrame:
    """df, exploded to a row a year from ``start`` to last_year, with the probability of completion by the year's end under
    an accelerated-failure-time model: 1 - exp(-(t / prediction)^(1 / scale))."""
    scale = model.stages[-1].scale
    rows = predict(model, df, features).drop("quantiles")
    rows = rows.withColumn("year", F.explode(F.when(F.year(start) <= last_year, F.sequence(F.year(start), F.lit(last_year))).otherwise(F.array())))
    passed = F.greatest(F.lit(0), F.datediff(F.make_date("year", F.lit(12), F.lit(31)), start))
    return rows.withColumn("completed", 1 - F.exp(-F.pow(passed / F.col("prediction"), F.lit(1 / scale)))).drop("prediction")


# Decisions


def archive_status(rows: DataFrame, entity: str, schedule: str, cost: str, least_labels: int = 30, least_entities: int = 10) -> DataFrame:
    """One row: labels of each kind, entities, and whether they suffice to validate a forward model."""
    found = rows.agg(F.count("*").alias("rows"), F.countDistinct(entity).alias("entities"), F.count(schedule).alias("schedule_labels"), F.count(cost).alias("cost_labels"))
    return found.withColumn("sufficient", (F.least("schedule_labels", "cost_labels") >= least_labels) & (F.col("entities") >= least_entities))


def promotion(book: DataFrame, least_gain: float = 10.0) -> DataFrame:
    """One row for paired predictions (see ``governance.LEDGER``): the gain of the challenger in per cent of the baseline's
    weighted error, the stages in which it is worse, and whether it takes the baseline's place: gain enough, no stage worse."""
    base, new = F.abs(F.col("baseline") - F.col("actual")), F.abs(F.col("challenger") - F.col("actual"))
    stage = book.groupBy("stage").agg(F.sum(F.col("weight") * base).alias("b"), F.sum(F.col("weight") * new).alias("c"))
    gain = F.try_divide(F.sum("b") - F.sum("c"), F.sum("b")) * 100
    found = stage.agg(gain.alias("gain"), F.count(F.when(F.col("c") > F.col("b"), 1)).alias("worse_stages"))
    return found.withColumn("promote", F.coalesce(F.col("gain") >= least_gain, F.lit(False)) & (F.col("worse_stages") == 0))


# Windows


def train_window(
    rows: DataFrame, base: Features, more: Features, label: str, weight: str, year: str, entity: str, stage: str, first: int, last: int, test_last: int,
    groups: dict[str, tuple[str, ...]] | None = None, least_train: int = 10, least_test: int = 2,
) -> dict:
    """Models of a period, scored on the years after it: the base features, those with what the audit lets in of the others,
    and that without each group. ``models`` holds the fitted pipelines, ``held`` the scored rows, the rest is plain data."""
    audits.require_disjoint([*base.numeric, *base.categorical, *more.numeric, *more.categorical], [label, weight, year])
    train, test = splits.years(rows, year, first, last), splits.years(rows, year, last + 1, test_last)
    n, m = (df.agg(F.countDistinct(entity)).first()[0] for df in (train, test))
    if n < least_train or m < least_test:
        raise ValueError(f"too few entities: {n} to train on, {m} to test on")
    both = train.join(test.select(entity).distinct(), entity, "left_semi").limit(1).count()
    if both:
        raise ValueError("entities are on both sides of the cut")
    off = train.groupBy(entity).agg(F.sum(weight).alias("_w")).where(F.abs(F.col("_w") - 1) > 1e-9).limit(1).count()
    if off:
        raise ValueError("weights don't sum to 1 an entity")
    # A category counts by its hash: available, and more than one.
    kinds = [F.when(F.col(x).isNotNull(), F.xxhash64(x)).alias(x) for x in more.categorical]
    asked = [*more.numeric, *more.categorical]
    audit = audits.feature_audit(train.select(year, *more.numeric, *kinds), asked, year).where("keep").collect() if asked else []
    used = {r["feature"] for r in audit}  # a row a feature
    whole = Features(tuple(dict.fromkeys((*base.numeric, *(x for x in more.numeric if x in used)))), tuple(dict.fromkeys((*base.categorical, *(x for x in more.categorical if x in used)))))
    variants = {"baseline": base, "lifecycle": whole} | {f"without {k}": whole.without(*gone) for k, gone in (groups or {}).items()}
    out = {"window": f"{first}_{last}", "training": [first, last], "testing": [last + 1, test_last], "entities": [n, m], "features": [*whole.numeric, *whole.categorical], "variants": {}, "models": {}}
    for name, own in variants.items():
        family, model, _ = selected(train, own, label, weight, year)
        held = predict(model, test, own)
        stages = held.groupBy(stage).agg(A.regression_metrics(label, "prediction", weight)["mae"].alias("mae"), F.count("*").alias("rows")).collect()  # a row a stage
        out["variants"][name] = {"family": family, **scores(held, label, weight), "stages": {str(r[stage]): {"mae": r["mae"], "rows": r["rows"]} for r in stages}}
        if name == "lifecycle":
            out["models"][name], out["held"] = model, held
    return out


def report(results: list[dict]) -> str:
    """Markdown: a section a window, a row a variant."""
    lines = ["# Models by window", ""]
    for w in results:
        lines += [f"## {w['training'][0]} to {w['training'][1]}, tested on {w['testing'][0]} to {w['testing'][1]}", "", "| Variant | Family | MAE | RMSE | R2 | Rows |", "|-|-|-|-|-|-|"]
        number = lambda x: "" if x is None else f"{x:.4f}"
        lines += [f"| {k} | {v['family']} | {number(v['mae'])} | {number(v['rmse'])} | {number(v['r2'])} | {v['rows']} |" for k, v in w["variants"].items()]
        lines.append("")
    return "\n".join(lines)
