"""Experiments from stages to an entry: kept stages, a ledger of paired predictions, a decision, and a record that can't change.

An experiment is a module, or any object, with ``NAME``, ``SEQUENCE`` and ``stages(context)``; its last stage gives the columns of a
ledger (``governance.LEDGER``). What it is compared under (data, window, cohort, metric) is frozen first, and a run under another
context than the frozen one is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.ml import bundles as B
from tidemark.ml import crossfit, harness
from tidemark.ml import lifecycle as L
from tidemark.ml.models import Features, families, fit, predict
from tidemark.operators import aggregates as A
from tidemark.operators import governance as G
from tidemark.operators import paths, versions


def registry() -> G.Registry:
    """Experiments by name; ``discover`` finds those of a package that opt in."""
    return G.Registry("stages")


def run(spark: SparkSession, experiment, sources: dict[str, DataFrame], context: dict, frozen: str, root: str, run_id: str, recorded_at: str, least_gain: float = 10.0, draws: int = 200) -> dict:
    """Runs an experiment's stages (those that are kept are read back), writes its ledger once, and records its entry.

    ``frozen`` is the digest that ``versions.freeze`` gave for the context under ``root/contexts``. If the context tells a
    ``cohort``, the ledger's must be that. The decision is promote for a gain of at least least_gain per cent with no stage worse
    and a bootstrap interval above 0, hold for a smaller gain, else reject."""
    root = root.rstrip("/")
    versions.require_frozen(spark, f"{root}/contexts", frozen, context)
    outputs = harness.run(spark, experiment.stages(context), sources, f"{root}/stages")
    book = G.ledger(list(outputs.values())[-1].frame)
    cohort = G.cohort(book)
    if context.get("cohort") not in (None, cohort):
        raise ValueError(f"the cohort is {cohort}, not that of the context")
    told = L.promotion(book, least_gain).first()
    interval = A.paired_bootstrap(book, "entity", "baseline_error", "challenger_error", draws).first()
    sure = interval["low"] is not None and interval["low"] > 0
    decision = "promote" if told["promote"] and sure else "hold" if (told["gain"] or 0.0) > 0 else "reject"
    manifest = G.write_ledger(book, f"{root}/ledgers/{experiment.NAME}/{run_id}")
    entry = {
        "experiment": experiment.NAME, "run": run_id, "recorded_at": recorded_at, "decision": decision, "context": frozen, "cohort": cohort, "gain": told["gain"],
        "worse_stages": told["worse_stages"], "interval": [interval["low"], interval["high"]], "ledger": manifest["digest"], "stages": harness.evidence(outputs),
    }
    # Whether a stage ran or was read back is of this call, not of the run.
    kept = entry | {"stages": [{k: v for k, v in s.items() if k != "reused"} for s in entry["stages"]]}
    B.record(spark, kept, f"{root}/registry")
    return entry


def run_all(spark: SparkSession, found: G.Registry, sources: dict[str, DataFrame], context: dict, frozen: str, root: str, run_id: str, recorded_at: str) -> dict[str, dict | str]:
    """Every registered experiment in turn under one context; one that fails is told by its reason and stops no other."""
    out: dict[str, dict | str] = {}
    for name, experiment in found:
        try:
            out[name] = run(spark, experiment, sources, context, frozen, root, run_id, recorded_at)
        except Exception as e:  # its reason is the result
            out[name] = f"{type(e).__name__}: {e}"
    return out


# A recipe: does the path that a cost has taken correct the forecasts of a line?


def _with_path(rows: DataFrame) -> DataFrame:
    return paths.path_features(rows, "entity", "cost", "escalation", "slippage")


def _paired(rows: DataFrame, numeric: list, path: list, last: int, folds: int) -> DataFrame:
    own, more = Features(tuple(numeric)), Features((*numeric, *path))
    line = families("actual", "weight")["linear"]
    early, late = rows.where(F.col("year") < last), rows.where(F.col("year") == last)
    oof = crossfit.rolling_out_of_fold(early, own, "year", "entity", line, folds)
    model, used, bound = crossfit.residual_booster(oof, more, "actual", "weight", estimator=crossfit.booster("_residual", "weight", rounds=10, least_rows=10))
    base = predict(fit(early, own, line), late, own).drop(*(f"{x}_missing" for x in numeric))
    return crossfit.boosted(base, model, used, bound).withColumnRenamed("base_prediction", "baseline").withColumnRenamed("prediction", "challenger")


class TrajectoryCost:
    """Path features enter through a bounded booster on rolling out-of-fold residuals. Rows have entity, day, as_of, year, cost,
    escalation, slippage, stage, sector, weight, actual and the context's numeric features."""

    NAME, SEQUENCE = "trajectory-cost", 12
    PATH = ("cost_revision_count", "abs_cost_revision_pct", "escalation_worsening_share")

    @classmethod
    def stages(cls, context: dict) -> list[harness.Stage]:
        return [
            harness.Stage("path", _with_path, ("rows",)),
            harness.Stage("paired", _paired, ("path",), {"numeric": context["features"], "path": list(cls.PATH), "last": context["test_year"], "folds": context.get("folds", 3)}),
        ]
