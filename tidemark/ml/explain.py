"""Why a model says what it says of a row: exact Shapley values of trees and lines, their largest parts for each row.

A tree's value for a row of which only some features are known is the average of its leaves that those features allow,
weighted by the training rows that went there. A leaf's Shapley values depend only on which conditions of its path the row
meets, at most 2 ^ depth patterns, so they are tabulated once for each leaf and looked up for whole batches of rows, once for
all rows of a batch that no condition tells apart. The parts of a row sum to its prediction less the base, the average of all leaves.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemark.ml.models import Features, prepared

#: Features on one path; a leaf's table has 2 ^ that many rows.
MOST = 14


@dataclass
class Leaf:
    """A leaf's value, the features on its path, the tests of each, and what the leaf adds to each of them by pattern."""

    value: float
    features: list[int]
    tests: list[list[tuple[str, float | frozenset[float], bool]]]
    shares: list[float]
    table: np.ndarray


def _nodes(node) -> dict:
    """A fitted node as plain data. ``cover`` is the weight of the training rows that reached it."""
    found = {"cover": float(node.impurityStats().count()), "value": float(node.prediction())}
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        feature = int(split.featureIndex())
        if split.getClass().getSimpleName() == "ContinuousSplit":
            test = ("at most", float(split.threshold()))
        else:
            test = ("among", frozenset(float(x) for x in split.leftCategories()))
        found |= {"feature": feature, "test": test, "left": _nodes(node.leftChild()), "right": _nodes(node.rightChild())}
    return found


def tree_nodes(model) -> list[tuple[float, dict]]:
    """(weight, root) of each tree of a fitted tree, forest or boosted regressor."""
    if hasattr(model, "trees"):
        weights = [float(w) for w in model.treeWeights]
        mean = 1.0 / sum(weights) if "RandomForest" in type(model).__name__ else 1.0
        return [(w * mean, _nodes(t._java_obj.rootNode())) for w, t in zip(weights, model.trees, strict=True)]
    return [(1.0, _nodes(model._java_obj.rootNode()))]


def _shapley(value: float, shares: list[float]) -> np.ndarray:
    """For each pattern of met conditions (bit k: those of the k-th feature), the leaf's Shapley value of each feature: the game
    gives value times 1 or 0 for known features that meet theirs or don't, and times its share for each unknown one."""
    m = len(shares)
    table = np.zeros((1 << m, m))
    weights = [factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)]
    for pattern in range(1 << m):
        met = [pattern >> k & 1 for k in range(m)]
        for j in range(m):
            # Coefficients by size of the known set: a polynomial product over the other features.
            sizes = np.ones(1)
            for k in range(m):
                if k != j:
                    sizes = np.convolve(sizes, [shares[k], met[k]])
            table[pattern, j] = value * (met[j] - shares[j]) * float(np.dot(sizes, weights))
    return table


def leaves(root: dict) -> list[Leaf]:
    out = []

    def walk(node: dict, path: dict[int, list], share: dict[int, float]) -> None:
        if "feature" not in node:
            order = sorted(path)
            if len(order) > MOST:
                raise ValueError(f"a leaf depends on {len(order)} features; at most {MOST} can be tabulated")
            shares = [share[f] for f in order]
            out.append(Leaf(node["value"], order, [path[f] for f in order], shares, _shapley(node["value"], shares)))
            return
        for side, left in (("left", True), ("right", False)):
            child, f = node[side], node["feature"]
            if child["cover"] <= 0:
                continue  # no training row went there, so no unknown feature leads there
            test = (*node["test"], left)
            walk(child, path | {f: [*path.get(f, []), test]}, share | {f: share.get(f, 1.0) * child["cover"] / node["cover"]})

    walk(root, {}, {})
    return out


def base_value(root: dict) -> float:
    """The average of the leaves by training rows."""
    if "feature" not in root:
        return root["value"]
    return sum(base_value(root[s]) * root[s]["cover"] for s in ("left", "right") if root[s]["cover"] > 0) / root["cover"]


def shapley_values(trees: list[tuple[float, list[Leaf]]], x: np.ndarray) -> np.ndarray:
    """Rows by features."""
    out = np.zeros(x.shape)
    met_before: dict[tuple, np.ndarray] = {}

    def met(feature: int, test: tuple) -> np.ndarray:
        kind, bound, left = test
        key = (feature, kind, bound)
        if key not in met_before:
            met_before[key] = x[:, feature] <= bound if kind == "at most" else np.isin(x[:, feature], list(bound))
        return met_before[key] if left else ~met_before[key]

    for weight, own in trees:
        for leaf in own:
            pattern = np.zeros(len(x), np.int64)
            for k, (f, tests) in enumerate(zip(leaf.features, leaf.tests, strict=True)):
                pattern |= np.logical_and.reduce([met(f, t) for t in tests]).astype(np.int64) << k
            found = leaf.table[pattern]
            for k, f in enumerate(leaf.features):
                out[:, f] += weight * found[:, k]
    return out


def told_apart(trees: list[tuple[float, list[Leaf]]]) -> list[tuple[int, str, np.ndarray]]:
    """All that the trees ask of each feature: its bounds in order, and each set of categories."""
    bounds: dict[int, set[float]] = {}
    among: set[tuple[int, frozenset[float]]] = set()
    for _, own in trees:
        for leaf in own:
            for f, tests in zip(leaf.features, leaf.tests, strict=True):
                for kind, bound, _left in tests:
                    if kind == "at most":
                        bounds.setdefault(f, set()).add(bound)
                    else:
                        among.add((f, bound))
    return [(f, "at most", np.array(sorted(b))) for f, b in sorted(bounds.items())] + [(f, "among", np.array(sorted(b))) for f, b in among]


def kinds(asked: list[tuple[int, str, np.ndarray]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each kind, and each row's kind: rows of a kind meet the same conditions of all trees."""
    code, size = np.zeros(len(x), np.int64), 1
    for f, kind, values in asked:
        if kind == "at most":
            digit, radix = np.searchsorted(values, x[:, f]), len(values) + 1  # NaN comes after all bounds, as it meets none
        else:
            digit, radix = np.isin(x[:, f], values), 2
        if size * radix >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            size = len(found)
        code = code * radix + digit
        size *= radix
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return first, which


def tree_parts(trees: list[tuple[float, list[Leaf]]], asked: list[tuple[int, str, np.ndarray]], onto: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows by source features; rows of a kind are worked out once."""
    first, which = kinds(asked, x)
    return (shapley_values(trees, x[first]) @ onto)[which]


def _sources(model: PipelineModel, df: DataFrame, features: Features) -> list[str]:
    """The source feature of each place of the vector: what was made of one feature counts together."""
    attrs = model.transform(prepared(df.limit(1), features)).schema["features"].metadata["ml_attr"]["attrs"]
    names = sorted((*features.numeric, *features.categorical), key=len, reverse=True)
    places = {a["idx"]: next(f for f in names if a["name"].startswith(f)) for kind in attrs.values() for a in kind}
    return [places[i] for i in range(len(places))]


def explained(model: PipelineModel, df: DataFrame, features: Features, means: list[float] | None = None, prefix: str = "part_") -> tuple[DataFrame, float, list[str]]:
    """df with the prediction and ``part_<feature>`` for each source feature; the base; and the features' names.

    For linear models the base is the prediction of the mean row, given by ``means`` of the vector's places (or the fit's
    rows, see ``vector_means``), and a part is the coefficient times the distance from it.
    """
    last = model.stages[-1]
    sources = _sources(model, df, features)
    names = list(dict.fromkeys(sources))
    onto = np.zeros((len(sources), len(names)))
    onto[np.arange(len(sources)), [names.index(s) for s in sources]] = 1.0
    scored = model.transform(prepared(df, features))
    made = [*(f"{c}_{k}" for c in features.categorical for k in ("index", "hot")), *(f"{n}_filled" for n in features.numeric), *(f"{n}_missing" for n in features.numeric)]
    rows = scored.withColumn("_x", vector_to_array("features")).drop("features", "rawPrediction", "probability", *made)
    kept = [c for c in rows.columns if c != "_x"]
    schema = rows.select(kept).schema
    for n in names:
        schema = schema.add(f"{prefix}{n}", "double")
    if hasattr(last, "coefficients"):
        if means is None:
            raise ValueError("lines are explained against a mean row")
        weights, centre = np.array(last.coefficients.toArray()), np.array(means)
        base = float(last.intercept + weights @ centre)
        values = lambda x: (x - centre) * weights @ onto
    else:
        roots = tree_nodes(last)
        base = sum(w * base_value(r) for w, r in roots)
        trees = [(w, leaves(r)) for w, r in roots]
        asked = told_apart(trees)
        shared = df.sparkSession.sparkContext.broadcast(trees)  # trees x leaves x 2 ^ depth numbers
        values = lambda x: tree_parts(shared.value, asked, onto, x)
    p = len(sources)

    def run(batches):
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
            parts = values(x)
            columns = [batch.column(c) for c in kept] + [pa.array(parts[:, i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(f"{prefix}{n}" for n in names)])

    return rows.mapInArrow(run, schema), base, names


def vector_means(model: PipelineModel, df: DataFrame, features: Features, weight: str | None = None) -> list[float]:
    """The (weighted) mean of each place of the features' vector."""
    from pyspark.ml.stat import Summarizer

    rows = model.transform(prepared(df, features))
    found = rows.agg(Summarizer.mean(F.col("features"), F.col(weight) if weight else F.lit(1.0))).first()[0]
    return [float(x) for x in found]


def top_factors(parts: DataFrame, names: list[str], k: int = 5, prefix: str = "part_") -> DataFrame:
    """The k largest parts of each row, by size, then name, as ``factors``: feature, impact, share of the k parts' sizes, and
    direction; ``rest`` is the sum of the other parts."""
    every = F.array(*(F.struct((-F.abs(f"{prefix}{n}")).alias("order"), F.lit(n).alias("feature"), F.col(f"{prefix}{n}").alias("impact")) for n in names))
    # Written out for each of the k: lambdas, and array_sort with its own, would be interpreted row by row.
    top = [F.get("_top", F.lit(i)) for i in range(min(k, len(names)))]
    total = F.lit(0.0) + sum((F.col(f"{prefix}{n}") for n in names), F.lit(0.0))
    rows = parts.withColumn("_top", F.slice(F.sort_array(every), 1, k)).withColumn("_total", total).drop(*(f"{prefix}{n}" for n in names))
    rows = rows.withColumn("_size", sum((F.abs(x["impact"]) for x in top), F.lit(0.0)))
    factor = lambda x: F.struct(
        x["feature"].alias("feature"), x["impact"].alias("impact"), F.coalesce(F.try_divide(F.abs(x["impact"]), F.col("_size")), F.lit(0.0)).alias("share"),
        F.when(x["impact"] >= 0, "increases").otherwise("reduces").alias("direction"),
    )
    rest = F.col("_total") - sum((x["impact"] for x in top), F.lit(0.0))
    return rows.withColumn("factors", F.array(*map(factor, top))).withColumn("rest", rest).drop("_top", "_total", "_size")


def global_parts(parts: DataFrame, names: list[str], prefix: str = "part_") -> DataFrame:
    """(feature, mean_impact): the mean size of each feature's part, the largest first."""
    means = parts.agg(*(F.avg(F.abs(f"{prefix}{n}")).alias(n) for n in names))
    return means.select(F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("mean_impact")) for n in names)))).orderBy(F.desc("mean_impact"), "feature")
