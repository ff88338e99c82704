"""Absolute and quantile loss: linear models and boosted trees for any quantile, their bands and calibration.

Linear: each step is a weighted least-squares problem whose sums Spark forms in one pass for all quantiles, and whose loss lies
above the pinball loss and touches it at the last step's residuals, so no step makes the loss worse. Rows of equal features are
packed together once, so that a step multiplies features once a run of them. Trees: each round grows a
tree on the loss's gradient and sets each leaf to the weighted quantile of its residuals, found by ``ranks``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.ml.models import Features, prepared, stages
from tidemark.operators import aggregates as A
from tidemark.operators.tables import stored


def pinball(label: str | Column, prediction: str | Column, q: float) -> Column:
    """q times what lies above the prediction, 1 - q times what lies below; half the absolute error at q = 0.5."""
    error = A.c(label) - A.c(prediction)
    return F.greatest(error * q, error * (q - 1))


#: Rows whose equal features are looked for together, and the most rows of one run.
PACKED_ROWS, RUN_ROWS = 1 << 18, 256


def _packed(rows: DataFrame) -> DataFrame:
    """rows of x (array), y and w as runs of equal x: x, and the y and w of its rows as bytes. A task holds PACKED_ROWS at once;
    an x may have several runs, and where all differ each row is a run."""

    def runs(x, y, w):
        # Equal rows have equal projections; neighbours that differ are parted even where theirs agree.
        order = np.argsort(x @ np.random.default_rng(7).random(x.shape[1]), kind="stable")
        x, y, w = x[order], y[order], w[order]
        start = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]).any(1))))
        size = np.diff(np.append(start, len(x)))
        pieces = -(-size // RUN_ROWS)
        start = np.repeat(start, pieces) + RUN_ROWS * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        ends = pa.py_buffer((8 * np.append(start, len(x))).astype(np.int32))
        own = x[start]
        cuts = pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1])
        binary = lambda v: pa.Array.from_buffers(pa.binary(), len(own), [None, ends, pa.py_buffer(v.astype("<f8"))])
        whole = pa.RecordBatch.from_pydict({"x": pa.ListArray.from_arrays(cuts, pa.array(own.ravel())), "y": binary(y), "w": binary(w)})
        for at in range(0, len(own), 4096):
            yield whole.slice(at, 4096)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            held.append((x, batch.column("y").to_numpy(zero_copy_only=False), batch.column("w").to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield from runs(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield from runs(*map(np.concatenate, zip(*held, strict=True)))

    return rows.select("x", "y", "w").mapInArrow(run, "x array<double>, y binary, w binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of runs, and where each run starts among them."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<f8", (at[-1] - at[0]) // 8, at[0]), (at[:-1] - at[0]) // 8


def _sums(rows: DataFrame, beta: np.ndarray, qs: list[float], smooth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each quantile X'VX, X'Vy' and the loss at beta, summed over packed rows in one pass. Rows of a run share x, so their
    weights are summed first."""
    k, p = beta.shape
    width = p * p + p + 1

    def run(batches):
        total = np.zeros((k, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
            (y, starts), (w, _) = _numbers(batch.column("y")), _numbers(batch.column("w"))
            sizes, run_w = np.diff(np.append(starts, len(y))), np.add.reduceat(w, starts)
            for i, q in enumerate(qs):
                r = y - np.repeat(x @ beta[i], sizes)
                far = np.abs(r)
                v = w / (smooth + far)
                total[i, : p * p] += (x.T @ (x * np.add.reduceat(v, starts)[:, None])).ravel()
                total[i, p * p : -1] += x.T @ (np.add.reduceat(v * y, starts) + (2 * q - 1) * run_w)
                total[i, -1] += 0.5 * (w @ far) + (q - 0.5) * (w @ r)
        yield pa.RecordBatch.from_pydict({"i": np.arange(k * width), "s": total.ravel()})

    found = rows.select("x", "y", "w").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # a row a sum
    flat = np.zeros(k * width)
    for r in found:
        flat[r["i"]] = r["s"]
    flat = flat.reshape(k, width)
    return flat[:, : p * p].reshape(k, p, p), flat[:, p * p : -1], flat[:, -1]


def _shape(rows: DataFrame) -> tuple[int, float, int]:
    """Features, the mean size of y and the number of packed rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = _numbers(batch.column("y"))[0]
                yield pa.RecordBatch.from_pydict({"p": [len(batch.column("x").flatten()) // batch.num_rows], "s": [float(np.abs(y).sum())], "n": [len(y)]})

    found = rows.select("x", "y").mapInArrow(run, "p long, s double, n long").agg(F.max("p"), F.sum("s"), F.sum("n")).first()
    return found[0] or 0, (found[1] or 0.0) / (found[2] or 1), found[2] or 0


@dataclass
class QuantileLines:
    """Linear models of several quantiles over the same features."""

    pipeline: PipelineModel
    features: Features
    beta: dict[float, list[float]]
    loss: dict[float, list[float]]

    def predict(self, df: DataFrame, out: dict[float, str]) -> DataFrame:
        """df with a column a quantile."""
        rows = _assembled(self.pipeline, df, self.features)
        line = lambda b: sum((F.col("_x")[i] * c for i, c in enumerate(b)), F.lit(0.0))
        return rows.withColumns({name: line(self.beta[q]) for q, name in out.items()}).drop("_x")


def _assembled(pipeline: PipelineModel, df: DataFrame, features: Features) -> DataFrame:
    """df with ``_x``, an array of 1 and the features, and without what the pipeline made on its way."""
    made = [*(f"{c}_{k}" for c in features.categorical for k in ("index", "hot")), *(f"{n}_filled" for n in features.numeric), *(f"{n}_missing" for n in features.numeric)]
    rows = pipeline.transform(prepared(df, features))
    return rows.withColumn("_x", F.concat(F.array(F.lit(1.0)), vector_to_array("features"))).drop("features", *made)


def quantile_lines(df: DataFrame, features: Features, label: str, weight: str, qs: tuple[float, ...] = (0.1, 0.5, 0.9), steps: int = 40, tolerance: float = 1e-5) -> QuantileLines:
    """Rows without a label or of no weight don't count. Steps end when no loss falls by more than ``tolerance`` of itself."""
    known = df.where(F.col(label).isNotNull() & (F.col(weight) > 0))
    pipeline = Pipeline(stages=stages(features)).fit(prepared(known, features))
    own = _assembled(pipeline, known.select("*", F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w")), features)
    rows = stored(_packed(own.select(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_w").alias("w"))), "quantile-rows")
    p, mean, n = _shape(rows)
    if not n:
        raise ValueError(f"no row has {label}")
    smooth = 1e-6 * max(mean, 1e-9)
    beta, losses, last = np.zeros((len(qs), p)), [[] for _ in qs], None
    # The first step has no residuals yet: a smoothing as large as the values makes it nearly least squares.
    wide = max(mean, 1.0) * 1e3
    for step in range(steps + 1):
        left, right, loss = _sums(rows, beta, list(qs), wide if step == 0 else smooth)
        if step:
            for own, x in zip(losses, loss, strict=True):
                own.append(float(x))
            if last is not None and np.all(last - loss <= tolerance * np.abs(last)):
                break
            last = loss
        if step == steps:
            break
        for i in range(len(qs)):
            ridge = 1e-10 * np.trace(left[i]) / p  # columns may depend on one another
            beta[i] = np.linalg.solve(left[i] + ridge * np.eye(p), right[i])
    return QuantileLines(pipeline, features, {q: beta[i].tolist() for i, q in enumerate(qs)}, {q: losses[i] for i, q in enumerate(qs)})


@dataclass
class QuantileTrees:
    """Boosted trees of one quantile: a start, and for each round a tree and the values of its leaves."""

    pipeline: PipelineModel
    features: Features
    q: float
    start: float
    step: float
    rounds: list[tuple[object, dict[int, float]]]

    def _applied(self, assembled: DataFrame, out: str) -> DataFrame:
        value = F.lit(self.start)
        for k, (tree, leaves) in enumerate(self.rounds):
            assembled = tree.setLeafCol(f"_leaf{k}").setPredictionCol(f"_grown{k}").transform(assembled)
            table = F.create_map(*(x for leaf, v in sorted(leaves.items()) for x in (F.lit(int(leaf)), F.lit(float(v)))))
            value = value + self.step * F.coalesce(F.element_at(table, F.col(f"_leaf{k}").cast("int")), F.lit(0.0))
        return assembled.withColumn(out, value).drop(*(f"_{c}{k}" for k in range(len(self.rounds)) for c in ("leaf", "grown")))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        made = [*(f"{c}_{k}" for c in self.features.categorical for k in ("index", "hot")), *(f"{n}_filled" for n in self.features.numeric), *(f"{n}_missing" for n in self.features.numeric)]
        return self._applied(self.pipeline.transform(prepared(df, self.features)), out).drop("features", *made)


def quantile_trees(df: DataFrame, features: Features, label: str, weight: str, q: float = 0.5, rounds: int = 10, depth: int = 4, step: float = 0.3, least_rows: int = 20, seed: int = 7) -> QuantileTrees:
    known = df.where(F.col(label).isNotNull() & (F.col(weight) > 0))
    pipeline = Pipeline(stages=stages(features)).fit(prepared(known, features))
    rows = pipeline.transform(prepared(known, features)).select("features", F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"))
    rows = stored(rows, "quantile-trees")
    start = A.weighted_quantile(rows, "_y", "_w", q).first()
    if start is None or start[0] is None:
        raise ValueError(f"no row has {label}")
    model = QuantileTrees(pipeline, features, q, float(start[0]), step, [])
    grower = DecisionTreeRegressor(featuresCol="features", labelCol="_gradient", weightCol="_w", maxDepth=depth, minInstancesPerNode=least_rows, seed=seed)
    for _ in range(rounds):
        now = model._applied(rows, "_now").withColumn("_residual", F.col("_y") - F.col("_now"))
        tree = grower.fit(now.withColumn("_gradient", F.when(F.col("_residual") > 0, q).otherwise(q - 1)))
        leaves = tree.setLeafCol("_leaf").setPredictionCol("_grown").transform(now)
        found = A.weighted_quantile(leaves, "_residual", "_w", q, ["_leaf"]).collect()  # a row a leaf, at most 2 ** depth
        model.rounds.append((tree, {int(r["_leaf"]): float(r["value"]) for r in found}))
    return model


def bands(df: DataFrame, low: str, mid: str, high: str) -> DataFrame:
    """The three columns put in order, so that bands never cross."""
    ordered = F.array_sort(F.array(low, mid, high))
    return df.withColumn("_bands", ordered).withColumns({c: F.element_at("_bands", i + 1) for i, c in enumerate((low, mid, high))}).drop("_bands")


def widened(df: DataFrame, factor: float, low: str, mid: str, high: str) -> DataFrame:
    m = F.col(mid)
    return df.withColumns({low: m - (m - F.col(low)) * factor, high: m + (F.col(high) - m) * factor})


def calibrated_bands(rows: DataFrame, features: Features, label: str, weight: str, year: str, nominal: float = 80.0) -> tuple[QuantileLines, dict]:
    """Lines of p10, p50 and p90 of all rows, and how far to widen them: the first factor of the ladder with which lines of the
    years before the last cover ``nominal`` - 2 per cent of the last. Without earlier years the factor is 1."""
    last = rows.agg(F.max(year)).first()[0]
    early, late = rows.where(F.col(year) < last), rows.where(F.col(year) == last)
    names = {0.1: "p10", 0.5: "p50", 0.9: "p90"}
    told = {"year": last, "factor": 1.0, "coverage": None, "rows": 0}
    if not early.isEmpty():
        held = bands(quantile_lines(early, features, label, weight).predict(late, names), "p10", "p50", "p90")
        held = stored(held.select(label, "p10", "p50", "p90"), "bands")
        factor = A.widening_factor(held, label, "p10", "p50", "p90", nominal).first()["factor"]
        wide = widened(held, factor, "p10", "p50", "p90").agg(A.interval_coverage(label, "p10", "p90").alias("c"), F.count("*").alias("n")).first()
        told |= {"factor": factor, "coverage": wide["c"], "rows": wide["n"]}
    return quantile_lines(rows, features, label, weight), told
