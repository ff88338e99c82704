"""Composed models that can take a production model's place, as single pipelines, and the guards on the way there.

A delay model is made of a prior over groups, a line over all rows, an accelerated-failure-time model of the days that are left
for rows that can be dated, and corrections of its out-of-fold residuals; rows that can't be dated, or that a gate holds back,
keep the line's value. All of it is one ``PipelineModel`` of own and Spark's stages, so a bundle keeps it as it keeps any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import AFTSurvivalRegression, LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.ml import bundles as B
from tidemark.ml import crossfit
from tidemark.ml import lifecycle as L
from tidemark.ml.models import Features, best_blend, families, stages
from tidemark.ml.stages import Derived, Dropped, HierarchicalPrior, Prepared, ShrunkCalibration
from tidemark.operators import splits
from tidemark.operators.tables import stored

GATE = "calibration_gate"


def evidence_gate(rows: DataFrame, entity: str, evidence: list[str], n: int, gate: str = GATE) -> DataFrame:
    """rows with whether their entity is among the n of most evidence: the mean share of ``evidence`` columns that its rows
    have, then the number of its rows, then its name. No outcome and no error enters."""
    share = sum((F.col(c).isNotNull().cast("double") for c in evidence), F.lit(0.0)) / len(evidence)
    per = rows.groupBy(entity).agg(F.avg(share).alias("_share"), F.count("*").alias("_rows"))
    chosen = per.orderBy(F.desc(F.round("_share", 12)), F.desc("_rows"), entity).limit(n).select(F.col(entity).alias("_chosen"))
    return rows.join(chosen, F.col(entity).eqNullSafe(F.col("_chosen")), "left").withColumn(gate, F.col("_chosen").isNotNull()).drop("_chosen")


def _dated(snapshot: str, planned: str) -> str:
    return f"`{snapshot}` IS NOT NULL AND `{planned}` IS NOT NULL"


class DelayParts:
    """Fitted parts over the same preprocessing: the line and the days that are left."""

    def __init__(self, rows: DataFrame, features: Features, label: str, weight: str, snapshot: str, planned: str):
        self.prepare = Pipeline(stages=[Prepared(list(features.numeric), list(features.categorical)), *stages(features)]).fit(rows)
        used = dict.fromkeys(["features", label, weight, snapshot, planned])
        ready = stored(self.prepare.transform(rows).select(*used), "delay-rows")
        self.line = LinearRegression(featuresCol="features", labelCol=label, weightCol=weight, predictionCol="_line", regParam=0.1).fit(ready)
        left = F.col(label) + F.datediff(planned, snapshot)
        dated = ready.where(F.expr(_dated(snapshot, planned))).withColumns({"_left": left.cast("double"), "_seen": F.lit(1.0)}).where("_left > 0")
        self.left = AFTSurvivalRegression(featuresCol="features", labelCol="_left", censorCol="_seen", predictionCol="_days_left", maxIter=30).fit(dated)
        self.raw = Derived("_aft", f"CASE WHEN {_dated(snapshot, planned)} THEN `_days_left` - datediff(`{planned}`, `{snapshot}`) END")

    def stages(self) -> list:
        return [*self.prepare.stages, self.line, self.left, self.raw]


def delay_model(
    train: DataFrame, features: Features, label: str, weight: str, year: str, entity: str, stage: str, snapshot: str, planned: str,
    levels: list[list[str]], strength: float = 40.0, folds: int = 3, out: str = "prediction", gate: str = GATE,
) -> PipelineModel:
    """Trained on rows with their outcomes. Priors of the training rows know strictly earlier years only; corrections come from
    years that each were predicted from all before them, and at least two of those are needed."""
    prior = HierarchicalPrior(levels, label, entity, year, "group_prior")
    rows = stored(prior.earlier(train), "delay-priors")
    own = Features((*features.numeric, "group_prior", "group_prior_support"), features.categorical)
    years = splits.rolling_folds(rows, year, entity, folds)
    if len(years) < 2:
        raise ValueError("corrections need two years with enough entities before them")
    held = []
    for y in years:
        parts = DelayParts(rows.where(F.col(year) < y), own, label, weight, snapshot, planned)
        held.append(PipelineModel(parts.stages()).transform(rows.where(F.col(year) == y)).where("_aft IS NOT NULL").select(stage, label, weight, "_aft"))
    oof = stored(reduce(DataFrame.unionByName, held), "delay-residuals")
    corrections = ShrunkCalibration("_aft", stage, label, weight, strength=strength, least=0.0).fit(oof)
    parts = DelayParts(rows, own, label, weight, snapshot, planned)
    made = [
        "features", "group_prior", "group_prior_support", "_line", "_days_left", "_aft", *(f"{c}_{k}" for c in own.categorical for k in ("index", "hot")),
        *(f"{n}_{k}" for n in own.numeric for k in ("filled", "missing")),
    ]
    said = Derived(out, f"CASE WHEN `_aft` IS NOT NULL AND coalesce(CAST(`{gate}` AS BOOLEAN), true) THEN `_aft` ELSE greatest(0.0D, `_line`) END", [gate])
    return PipelineModel([prior.fit(train), *parts.stages(), corrections, said, Dropped([c for c in made if c != out])])


def cost_model(oof: DataFrame, base: PipelineModel, features: Features, label: str, prediction: str, weight: str, stage: str, strength: float = 40.0, out: str = "prediction") -> PipelineModel:
    """A fitted base model (``models.fit``) with shrunk corrections learned from out-of-fold rows, which have ``prediction``."""
    corrections = ShrunkCalibration(prediction, stage, label, weight, strength=strength).fit(oof)
    corrections._set(prediction=out)
    made = ["features", *(f"{c}_{k}" for c in features.categorical for k in ("index", "hot")), *(f"{n}_{k}" for n in features.numeric for k in ("filled", "missing"))]
    renamed = [] if out == "prediction" else [Derived(out, "prediction"), Dropped(["prediction"])]
    return PipelineModel([Prepared(list(features.numeric), list(features.categorical)), *base.stages, *renamed, corrections, Dropped(made)])


def blend_model(train: DataFrame, features: Features, label: str, weight: str, year: str, entity: str, folds: int = 3, steps: int = 10, out: str = "prediction") -> tuple[PipelineModel, dict[str, float]]:
    """Models of all families over one preprocessing, and their mean by the weights of the grid that served best on years that
    each were predicted from all before them; as one pipeline, with the weights."""
    names = list(families(label, weight))
    oof = crossfit.rolling_out_of_fold(train, features, year, entity, {f"_{n}": e for n, e in families(label, weight).items()}, folds)
    best = best_blend(oof, [f"_{n}" for n in names], label, weight, steps).first()
    weights = {n: float(best[f"w__{n}"]) for n in names}
    prepare = Pipeline(stages=[Prepared(list(features.numeric), list(features.categorical)), *stages(features)]).fit(train)
    ready = stored(prepare.transform(train), "blend-rows")
    fitted = [e.copy({e.predictionCol: f"_{n}"}).fit(ready) for n, e in families(label, weight).items() if weights[n] > 0]
    said = Derived(out, " + ".join(f"{w}D * `_{n}`" for n, w in weights.items() if w > 0))
    made = ["features", *(f"_{n}" for n in names), *(f"{c}_{k}" for c in features.categorical for k in ("index", "hot")), *(f"{n}_{k}" for n in features.numeric for k in ("filled", "missing"))]
    return PipelineModel([*prepare.stages, *fitted, said, Dropped(made)]), weights


def promote(spark: SparkSession, path: str, name: str, model: PipelineModel, held: DataFrame, label: str, weight: str, run: str, current: str, challenger: str, least_gain: float = 0.0, expected_rows: int | None = None) -> dict:
    """Puts ``model`` into a bundle in the place of the one called ``name``, if it earns it, and returns the new manifest.

    ``held`` are rows that neither has seen, with both predictions; ``expected_rows`` is how many they have to be, where the
    cohort is agreed on. An error, and no change, if the gain in per cent isn't above ``least_gain``, if the cohort is another
    one, or if the bundle isn't valid. The other models' files stay as they were, which is checked by their digests.
    """
    metadata, manifest = B.check(spark, path, (name,))
    old, new = (L.scores(held, label, weight, p) for p in (current, challenger))
    if expected_rows is not None and old["rows"] != expected_rows:
        raise ValueError(f"the cohort has {old['rows']} rows instead of {expected_rows}")
    gain = 100 * (old["mae"] - new["mae"]) / old["mae"] if old["mae"] else 0.0
    if not gain > least_gain:
        raise ValueError(f"a gain of {gain:.4f} per cent doesn't suffice")
    told = {"model": name, "run": run, "gain": gain, "mae": new["mae"], "previous_mae": old["mae"], "rows": new["rows"]}
    metadata["promotions"] = [*metadata.get("promotions", []), told]
    return B.replaced(spark, path, name, model, metadata, manifest, run)
