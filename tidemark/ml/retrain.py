"""One call from training rows to a published bundle: cost, delay and risk of a window, its report, its evidence and its entry;
and what several bundles say of the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.ml import bundles as B
from tidemark.ml import lifecycle as L
from tidemark.ml.models import Features, fit, predict
from tidemark.ml.stages import Derived
from tidemark.operators import aggregates as A
from tidemark.operators import governance as G
from tidemark.operators import splits, versions
from tidemark.operators.tables import stored


@dataclass(frozen=True)
class Plan:
    """What a window is trained on: columns of the rows, features, and the targets by name."""

    base: Features
    more: Features
    targets: dict[str, str] = field(default_factory=lambda: {"cost": "final_cost_overrun_pct", "delay": "final_delay_days"})
    risk: str | None = "risk"
    entity: str = "canonical_id"
    year: str = "completion_year"
    stage: str = "stage"
    weight: str = "weight"


def _risk(train: DataFrame, features: Features, label: str, classes: int) -> PipelineModel:
    """A forest with balanced class weights, or the only class there is, as a pipeline in either case."""
    known = train.where(F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(label).agg(F.count("*")).collect()}  # a row a class
    if not sizes:
        raise ValueError(f"no row has {label}")
    if len(sizes) == 1:
        return Pipeline(stages=[Derived("prediction", f"{float(next(iter(sizes)))}D")]).fit(known)
    total = sum(sizes.values())
    balance = F.create_map(*(F.lit(x) for c, n in sorted(sizes.items()) for x in (c, total / (classes * n))))
    return fit(known.withColumn("_w", F.element_at(balance, F.col(label))), features, RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="_w", numTrees=20, maxDepth=6, seed=7))


def _risk_scores(held: DataFrame, label: str, weight: str, classes: int) -> dict:
    names = [str(i) for i in range(classes)]
    rows = held.where(F.col(label).isNotNull()).select(F.col(label).cast("int").cast("string").alias("actual"), F.col("prediction").cast("int").cast("string").alias("said"), F.col(weight).alias("_w"))
    found = A.classification_metrics(A.confusion(rows, "actual", "said", names, F.col("_w")), "actual", "said").first()
    return found.asDict()


def retrain(spark: SparkSession, rows: DataFrame, plan: Plan, first: int, last: int, test_last: int, root: str, run: str, recorded_at: str, classes: int = 4) -> dict:
    """Trains every target on the years first to last, scores them on those up to test_last, and writes under ``root``:
    ``models/<window>`` (the bundle), ``validation/<window>/run=<run>`` (the scored rows), ``reports/<window>-<run>.md`` and
    the registry's entry, in this order. Returns metrics, paths and the decision: promote where no target is worse than in the
    bundle that it replaces, else hold. The guards of ``lifecycle.train_window`` hold for each target; a window that breaks one
    leaves everything as it was."""
    root, window = root.rstrip("/"), f"{first}_{last}"
    rows = stored(rows, "retrain-rows")
    found, models = {}, {}
    for name, label in plan.targets.items():
        found[name] = L.train_window(rows.where(F.col(label).isNotNull()), plan.base, plan.more, label, plan.weight, plan.year, plan.entity, plan.stage, first, last, test_last)
        models[name] = found[name]["models"]["lifecycle"]
    features = {n: w["features"] for n, w in found.items()}
    numeric = {*plan.base.numeric, *plan.more.numeric}
    own = {n: Features(tuple(f for f in fs if f in numeric), tuple(f for f in fs if f not in numeric)) for n, fs in features.items()}
    test = splits.years(rows, plan.year, last + 1, test_last)
    metrics = {n: w["variants"]["lifecycle"] for n, w in found.items()}
    if plan.risk:
        models["risk"] = _risk(splits.years(rows, plan.year, first, last), plan.base, plan.risk, classes)
        own["risk"], features["risk"] = plan.base, [*plan.base.numeric, *plan.base.categorical]
        metrics["risk"] = _risk_scores(predict(models["risk"], test, plan.base), plan.risk, plan.weight, classes)
    dataset = rows.transform(G.fingerprint).first()["digest"]
    path = f"{root}/models/{window}"
    previous = B.check(spark, path)[0]["metrics"] if B.exists(spark, f"{path}/manifest") else {}
    worse = sorted(n for n, label in plan.targets.items() if n in previous and metrics[n]["mae"] > previous[n]["mae"])
    decision = "hold" if worse else "promote"
    told = {"window": [first, last, test_last], "metrics": metrics, "target_features": features, "targets": dict(plan.targets) | ({"risk": plan.risk} if plan.risk else {}), "recorded_at": recorded_at}
    out = {"run": run, "dataset": dataset, "metrics": metrics, "decision": decision, "worse": worse, "path": path}
    if decision == "promote":
        B.save(spark, models, told, path, run, dataset, sorted({f for fs in features.values() for f in fs}))
    out["validation"] = f"{root}/validation/{window}/run={run}"
    scored(test, {n: (models[n], own[n]) for n in models}).select(plan.entity, plan.year, plan.stage, plan.weight, *plan.targets.values(), *([plan.risk] if plan.risk else []), *(f"predicted_{n}" for n in models)).write.parquet(out["validation"])
    out["report"] = f"{root}/reports/{window}-{run}.md"
    if not versions.create(spark, out["report"], L.report(list(found.values()))):
        raise ValueError(f"{out['report']} is there already")
    B.record(spark, {"experiment": f"window-{window}", "run": run, "recorded_at": recorded_at, "decision": decision, "dataset": dataset, "worse": worse}, f"{root}/registry")
    return out


def scored(rows: DataFrame, models: dict[str, tuple[PipelineModel, Features]]) -> DataFrame:
    """rows with ``predicted_<name>`` of every model, in one scan. Features come out as they went in."""
    kept = rows.columns
    for name, (model, features) in models.items():
        own = {c: f"_in_{c}" for c in (*features.numeric, *features.categorical)}
        ready = rows.select("*", *(F.col(c).alias(k) for c, k in own.items()))
        found = predict(model, ready, features, f"predicted_{name}").drop(*(f"{x}_missing" for x in features.numeric), "probability")
        kept = [*kept, f"predicted_{name}"]
        rows = found.drop(*own).withColumnsRenamed({k: c for c, k in own.items()}).select(*kept)
    return rows


def comparable(rows: DataFrame, entity: str, seen: dict[str, DataFrame]) -> DataFrame:
    """The rows of entities that none of the models has been trained on; ``seen`` has the entities of each."""
    for known in seen.values():
        gone = known.select(F.col(entity).alias("_seen")).distinct()
        rows = rows.join(gone, F.col(entity).eqNullSafe(F.col("_seen")), "left_anti")
    return rows


def compared(rows: DataFrame, models: dict[str, tuple[PipelineModel, Features]], label: str, weight: str, entity: str, seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """(model, mae, rmse, r2, rows, entities, wins): all models on the same rows, those that none of them has seen. A row's win
    goes to the model of least error, the first in order on ties. No row that all may judge is an error."""
    held = comparable(rows.where(F.col(label).isNotNull()), entity, seen or {})
    both = stored(scored(held, models).select(label, weight, entity, *(f"predicted_{n}" for n in models)), "compared")
    if both.isEmpty():
        raise ValueError("no row is one that all models may judge")
    errors = F.array(*(F.struct(F.abs(F.col(label) - F.col(f"predicted_{n}")).alias("error"), F.lit(i).alias("place")) for i, n in enumerate(models)))
    both = both.withColumn("_best", F.array_min(errors)["place"])
    parts = [
        both.agg(*(v.alias(k) for k, v in A.regression_metrics(label, f"predicted_{n}", weight).items() if k != "mape"), F.countDistinct(entity).alias("entities"), F.count_if(F.col("_best") == i).alias("wins"))
        .select(F.lit(n).alias("model"), "mae", "rmse", "r2", "rows", "entities", "wins")
        for i, n in enumerate(models)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evolution(history: DataFrame, models: dict[str, tuple[PipelineModel, Features]], entity: str, day: str) -> DataFrame:
    """What each model said at every snapshot: (entity, day, model, predicted, change from the snapshot before). Snapshots are
    those of the history; nothing is put between them."""
    said = scored(history, models).select(entity, day, F.inline(F.array(*(F.struct(F.lit(n).alias("model"), F.col(f"predicted_{n}").cast("double").alias("predicted")) for n in models))))
    path = Window.partitionBy(entity, "model").orderBy(day)
    return said.withColumn("change", F.col("predicted") - F.lag("predicted").over(path))


def bundle_models(spark: SparkSession, paths: dict[str, str], target: str, categorical: tuple[str, ...] = ()) -> tuple[dict[str, tuple[PipelineModel, Features]], dict[str, dict]]:
    """A target's model of each of several bundles, with its features, and the bundles' metadata; every bundle is checked."""
    models, told = {}, {}
    for name, path in paths.items():
        metadata, _ = B.check(spark, path, (target,))
        fs = metadata["target_features"][target]
        models[name] = (PipelineModel.load(f"{path}/models/{target}"), Features(tuple(f for f in fs if f not in categorical), tuple(f for f in fs if f in categorical)))
        told[name] = metadata
    return models, told


#: The windows that a full report covers: first and last year of training, last year of the test.
REQUIRED = ((2001, 2015, 2021), (2015, 2021, 2024))


def required_windows(spark: SparkSession, rows: DataFrame, plan: Plan, root: str, run: str, recorded_at: str, windows: tuple[tuple[int, int, int], ...] = REQUIRED, classes: int = 4) -> dict:
    """Retrains every window and writes one report over all of them, ``reports/windows-<run>.md``. A window that can't be trained
    is told with its reason; none at all is an error."""
    done, failed = {}, {}
    for first, last, test_last in windows:
        try:
            done[f"{first}_{last}"] = retrain(spark, rows, plan, first, last, test_last, root, run, recorded_at, classes)
        except ValueError as e:
            failed[f"{first}_{last}"] = str(e)
    if not done:
        raise ValueError("; ".join(f"{w}: {why}" for w, why in failed.items()))
    lines = ["# Required windows", "", "| Window | Target | MAE | RMSE | R2 | Rows | Decision |", "|-|-|-|-|-|-|-|"]
    number = lambda x: "" if x is None else f"{x:.4f}"
    for window, found in done.items():
        for name in plan.targets:
            m = found["metrics"][name]
            lines.append(f"| {window} | {name} | {number(m['mae'])} | {number(m['rmse'])} | {number(m['r2'])} | {m['rows']} | {found['decision']} |")
    lines += ["", *(f"{w} could not be trained: {why}." for w, why in failed.items()), ""]
    path = f"{root.rstrip('/')}/reports/windows-{run}.md"
    if not versions.create(spark, path, "\n".join(lines)):
        raise ValueError(f"{path} is there already")
    return {"windows": done, "failed": failed, "report": path}
