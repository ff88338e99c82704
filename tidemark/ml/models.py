"""Cost and delay models: preprocessing, families, temporal selection, blends, calibration bands.

Only pyspark.ml is used here; ``pinball`` has absolute and quantile loss, ``cox`` proportional hazards, ``crossfit`` boosters on
residuals, ``stages`` and ``promoted`` composed models.
"""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression, DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import ranks
from tidemark.operators.tables import stored


@dataclass(frozen=True)
class Features:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()

    def without(self, *names: str) -> Features:
        return Features(tuple(n for n in self.numeric if n not in names), tuple(c for c in self.categorical if c not in names))


def prepared(df: DataFrame, features: Features) -> DataFrame:
    """Missing indicators beside the numbers; missing categories as a category of their own."""
    flags = [F.col(n).isNull().cast("double").alias(f"{n}_missing") for n in features.numeric]
    numbers = [F.col(n).cast("double").alias(n) for n in features.numeric]
    kinds = [F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias(c) for c in features.categorical]
    rest = [c for c in df.columns if c not in (*features.numeric, *features.categorical)]
    return df.select(*rest, *numbers, *flags, *kinds)


def stages(features: Features) -> list:
    n, c = features.numeric, features.categorical
    out = [Imputer(strategy="median", inputCols=list(n), outputCols=[f"{x}_filled" for x in n])] if n else []
    if c:
        out += [
            StringIndexer(inputCols=list(c), outputCols=[f"{x}_index" for x in c], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{x}_index" for x in c], outputCols=[f"{x}_hot" for x in c], handleInvalid="keep"),
        ]
    return [*out, VectorAssembler(inputCols=[*(f"{x}_filled" for x in n), *(f"{x}_missing" for x in n), *(f"{x}_hot" for x in c)], outputCol="features")]


def families(label: str, weight: str, seed: int = 7) -> dict:
    common = {"featuresCol": "features", "labelCol": label, "weightCol": weight, "predictionCol": "prediction"}
    return {
        "linear": LinearRegression(**common, regParam=0.1, elasticNetParam=0.0),
        "forest": RandomForestRegressor(**common, numTrees=20, maxDepth=6, seed=seed),
        "boosted": GBTRegressor(**common, maxIter=15, maxDepth=4, seed=seed),
    }


#: Estimators whose fit holds the rows of a task together, in memory or on disk, and the most rows a task then gets.
HOLDING = (RandomForestRegressor, RandomForestClassifier, GBTRegressor)
TASK_ROWS = 250_000


def dealt(df: DataFrame) -> DataFrame:
    """df over as many tasks as keep each at TASK_ROWS or so, however large the table."""
    tasks = -(-df.count() // TASK_ROWS)
    return df.repartition(tasks) if tasks > 1 else df


#: Rows are packed where they are at least so many times as many as their different features.
PACKED_TIMES = 8
#: Rows whose draws a task makes at once.
DRAWN_ROWS = 500_000


def _sums_suffice(estimator) -> bool:
    """Whether a fit reads no more of rows of equal features than the sums of their weights, labels and squared labels: least squares,
    and boosted trees that draw no rows and count none in a leaf."""
    if isinstance(estimator, LinearRegression):
        return estimator.getLoss() == "squaredError"
    plain = isinstance(estimator, GBTRegressor) and estimator.getLossType() == "squared" and not estimator.isDefined("validationIndicatorCol")
    return plain and estimator.getSubsamplingRate() == 1 and estimator.getMinInstancesPerNode() == 1


def _columns(estimator) -> tuple[str, str | None]:
    return estimator.getLabelCol(), estimator.getWeightCol() if estimator.isSet("weightCol") else None


def _keys(features: Features, by: tuple = ()) -> list[str]:
    return list(dict.fromkeys([*by, *features.numeric, *features.categorical]))


def _mark(features: Features):
    """A hash that tells prepared rows of different features apart, nulls included."""
    return F.xxhash64(*features.numeric, *(f"{n}_missing" for n in features.numeric), *features.categorical)


def packed(rows: DataFrame, features: Features, label: str, weight: str | None, by: tuple = ()) -> DataFrame | None:
    """Prepared rows, with those of equal features (and columns ``by``) as two, or one where labels agree, of the same weight, mean
    and variance of labels; weight as ``_weight``, ``_rows`` in proportion to their number. None where too few rows share their
    features. A missing label or weight, and a weight below 0, stay, for the fit to refuse."""
    keys = _keys(features, by)
    n, different = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*keys))).first()
    if n < PACKED_TIMES * different:
        return None
    y, w = F.col(label).cast("double"), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    whole = (F.count(y) == F.count("*")) & (F.count(w) == F.count("*"))
    sums = rows.groupBy(*keys).agg(
        F.when(whole, F.when(F.min(w) < 0, F.min(w)).otherwise(F.sum(w))).alias("_weight"), F.sum(w * y).alias("_s"), F.sum(w * y * y).alias("_q"),
        F.avg(y).alias("_plain"), F.count("*").alias("_n"),
    )
    mean = F.when(F.col("_weight").isNotNull(), F.coalesce(F.try_divide("_s", "_weight"), "_plain"))
    square = F.col("_mean") * F.col("_mean")
    off = F.sqrt(F.greatest(F.coalesce(F.try_divide("_q", "_weight"), square) - square, F.lit(0.0)))
    both = F.array_distinct(F.array(F.col("_mean") - F.col("_off"), F.col("_mean") + F.col("_off")))
    told = sums.withColumn("_mean", mean).withColumn("_off", off).withColumn("_both", both)
    flags = [F.col(n).isNull().cast("double").alias(f"{n}_missing") for n in features.numeric]
    rows_each = F.when(F.size("_both") == 2, F.col("_n")).otherwise(2 * F.col("_n")).alias("_rows")
    return stored(told.select(*keys, *flags, rows_each, (F.col("_weight") / F.size("_both")).alias("_weight"), F.explode("_both").alias(label)), "packed")


def _prepared_by(packs: DataFrame, features: Features) -> PipelineModel:
    """``stages`` as fitted on the rows that were packed: medians and orders of categories from numbers of rows."""
    out = []
    for stage in stages(features):
        if isinstance(stage, Imputer):
            known = {x: F.nanvl(F.col(x), F.lit(None).cast("double")) for x in features.numeric}
            middle = packs.select(*(v.alias(x) for x, v in known.items()), "_rows").agg(*(F.expr(f"percentile(`{x}`, 0.5D, _rows)").alias(x) for x in known)).first()
            model = stage.fit(packs.agg(*(F.max(F.when(v <= F.lit(middle[x]), v)).alias(x) for x, v in known.items())))  # the lower of two
        elif isinstance(stage, StringIndexer):
            counts = (packs.groupBy(c).agg(F.sum("_rows").alias("_n")).orderBy(F.desc("_n"), c) for c in features.categorical)
            labels = [[r[0] for r in found.collect()] for found in counts]  # a row a category
            model = StringIndexerModel.from_arrays_of_labels(labels, stage.getInputCols(), stage.getOutputCols(), stage.getHandleInvalid())
        else:
            model = stage.fit(packs) if isinstance(stage, OneHotEncoder) else stage
        packs = model.transform(packs)
        out.append(model)
    return PipelineModel(out)


def _apart(estimator) -> bool:
    """Whether its trees can be fitted apart, each on sums of the rows that it draws: a forest's, and those of a booster by rounds."""
    if isinstance(estimator, RandomForestRegressor):
        return estimator.getBootstrap() and estimator.getSubsamplingRate() == 1 and estimator.getMinInstancesPerNode() == 1 and estimator.getNumTrees() > 1
    return isinstance(estimator, GBTRegressor) and estimator.getLossType() == "squared" and not estimator.isDefined("validationIndicatorCol") and estimator.getFeatureSubsetStrategy() in ("auto", "all")


def _drawn(rows: DataFrame, features: Features, label: str, weight: str | None, trees: int, seed: int, share: float | None) -> DataFrame:
    """``_mark`` of the features and, for each tree, the sums ``n0``, ... of rows, ``w0``, ... of weights and ``s0``, ... of weighted labels
    over what it draws. Each row is drawn for itself: with this share as its chance, or, without one, a number of times that is
    Poisson with mean 1, as a forest's bootstrap does."""
    names = [f"{k}{i}" for k in "nws" for i in range(trees)]

    def run(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])

        def sums(held):
            mark, w, y = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
            marks, place = np.unique(mark, return_inverse=True)
            found = {"_mark": marks}
            for i in range(trees):
                n = rng.poisson(1.0, len(w)) if share is None else (rng.random(len(w)) < share).astype(np.int64)
                found[f"n{i}"], found[f"w{i}"], found[f"s{i}"] = (np.bincount(place, weights=x, minlength=len(marks)) for x in (n, n * w, n * w * y))
            return pa.RecordBatch.from_pydict({c: found[c] for c in ("_mark", *names)})

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= DRAWN_ROWS:
                yield sums(held)
                held, n = [], 0
        if n:
            yield sums(held)

    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    given = rows.select(_mark(features).alias("_mark"), w.alias("w"), F.col(label).cast("double").alias("y"))
    found = given.mapInArrow(run, ", ".join(["_mark long", *(f"{c} double" for c in names)]))
    return found.groupBy("_mark").agg(*(F.sum(c).alias(c) for c in names))


class Training:
    """Rows to fit these estimators on. What prepares features is fitted once; rows of equal features are packed once, where they all
    have one label and weight, also for parts of the rows that conditions on the columns ``by`` make. With ``apart``, a forest on
    packed rows is one of trees fitted apart, and a booster that draws rows or counts them in leaves is one of rounds fitted apart."""

    def __init__(self, df: DataFrame, features: Features, estimators: list, by: tuple = (), apart: bool = False):
        self.features, self.rows, self.packs, self.fitted, self.apart = features, prepared(df, features), None, None, apart
        columns = {_columns(e) for e in estimators if isinstance(e, (LinearRegression, *HOLDING))}
        if len(columns) == 1 and _keys(features) and any(_sums_suffice(e) or apart and _apart(e) for e in estimators):
            self.columns = columns.pop()
            self.packs = packed(self.rows, features, *self.columns, by)

    def where(self, condition) -> Training:
        part = copy(self)
        part.rows, part.packs, part.fitted = self.rows.where(condition), None if self.packs is None else self.packs.where(condition), None
        return part

    @property
    def before(self) -> PipelineModel:
        if self.fitted is None:
            self.fitted = Pipeline(stages=stages(self.features)).fit(self.rows) if self.packs is None else _prepared_by(self.packs, self.features)
        return self.fitted

    def fit(self, estimator) -> PipelineModel:
        rows = self.rows
        if self.packs is not None and _sums_suffice(estimator):
            rows, estimator = self.packs, estimator.copy({estimator.weightCol: "_weight"})
        elif self.packs is not None and self.apart and _apart(estimator):
            return self._forest(estimator) if isinstance(estimator, RandomForestRegressor) else self._rounds(estimator)
        rows = self.before.transform(rows)
        if isinstance(estimator, HOLDING):
            label, weight = _columns(estimator)
            rows = dealt(rows.select("features", label, *([weight] if weight else [])))
        return PipelineModel([*self.before.stages, estimator.fit(rows)])

    def _sums(self, estimator, trees: int, share: float | None) -> DataFrame:
        kinds = self.packs.select(*_keys(self.features), *(f"{x}_missing" for x in self.features.numeric)).distinct().withColumn("_mark", _mark(self.features))
        sums = _drawn(self.rows, self.features, *self.columns, trees, estimator.getSeed(), share)
        return stored(sums.join(self.before.transform(kinds).select("_mark", "features"), "_mark"), "drawn")

    def _together(self, trees: list, each: list[float], estimator) -> PipelineModel:
        names = [f"_tree{i}" for i in range(len(trees))]
        total = " + ".join(f"{x!r}D * {name}" for x, name in zip(each, names, strict=True))
        whole = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(names)}), {total} AS {estimator.getPredictionCol()} FROM __THIS__")
        return PipelineModel([*self.before.stages, *trees, whole])

    def _forest(self, estimator) -> PipelineModel:
        n, way = estimator.getNumTrees(), estimator.getFeatureSubsetStrategy()
        sums = self._sums(estimator, n, None)
        settings = {estimator.numTrees: 1, estimator.bootstrap: False, estimator.featureSubsetStrategy: "onethird" if way == "auto" else way, estimator.labelCol: "_y", estimator.weightCol: "_w"}

        def tree(i: int):
            own = sums.where(F.col(f"w{i}") > 0).select("features", (F.col(f"s{i}") / F.col(f"w{i}")).alias("_y"), F.col(f"w{i}").alias("_w"))
            return estimator.copy({**settings, estimator.seed: estimator.getSeed() + i, estimator.predictionCol: f"_tree{i}"}).fit(dealt(own))

        with ThreadPool(4) as pool:
            trees = pool.map(inheritable_thread_target(sums.sparkSession)(tree), range(n))
        return self._together(trees, [1 / n] * n, estimator)

    def _rounds(self, estimator) -> PipelineModel:
        """Each round's tree is fitted without the least number of rows in a leaf. If all its leaves have that many, it is the tree that
        would be found with it; else it is fitted again, where features of that many rows or more stand as just so many, and
        others as many as they have."""
        n, step, least = estimator.getMaxIter(), estimator.getStepSize(), estimator.getMinInstancesPerNode()
        rows = self._sums(estimator, n, estimator.getSubsamplingRate()).withColumn("_f", F.lit(0.0))
        trees, each = [], [1.0] + [step] * (n - 1)  # as Spark's booster: the first tree counts whole
        for i in range(n):
            left = F.col(f"s{i}") / F.col(f"w{i}") - F.col("_f")
            own = rows.where(F.col(f"w{i}") > 0).select("features", (left if i == 0 else 2 * left).alias("_y"), F.col(f"w{i}").alias("_w"), F.col(f"n{i}").alias("_n"))
            single = DecisionTreeRegressor(
                featuresCol="features", labelCol="_y", weightCol="_w", predictionCol=f"_tree{i}", maxDepth=estimator.getMaxDepth(), maxBins=estimator.getMaxBins(),
                minInfoGain=estimator.getMinInfoGain(), minWeightFractionPerNode=estimator.getMinWeightFractionPerNode(), seed=estimator.getSeed() + i,
            )
            tree = single.fit(dealt(own))
            if least > 1:
                leaves = tree.copy({tree.leafCol: "_leaf"}).transform(own).groupBy("_leaf").agg(F.sum("_n").alias("_n"))
                if leaves.agg(F.min("_n")).first()[0] < least:
                    k = F.least(F.col("_n"), F.lit(least)).cast("int")
                    counted = own.select("features", "_y", F.explode(F.array_repeat(F.col("_w") / k, k)).alias("_w"))
                    tree = single.copy({single.minInstancesPerNode: least}).fit(dealt(counted))
            rows = stored(tree.transform(rows).withColumn("_f", F.col("_f") + each[i] * F.col(f"_tree{i}")).drop(f"_tree{i}"), "round")
            trees.append(tree)
        return self._together(trees, each, estimator)


def fit(df: DataFrame, features: Features, estimator) -> PipelineModel:
    return Training(df, features, [estimator]).fit(estimator)


def predict(model: PipelineModel, df: DataFrame, features: Features, out: str = "prediction") -> DataFrame:
    return model.transform(prepared(df, features)).drop("features", "rawPrediction", *(f"{c}_{k}" for c in features.categorical for k in ("index", "hot")), *(f"{n}_filled" for n in features.numeric)).withColumnRenamed("prediction", out)


def selected(train: DataFrame, features: Features, label: str, weight: str, year: str) -> tuple[str, PipelineModel, DataFrame]:
    """The family with the least weighted error on the last year, refitted on all; also the scores of all families."""
    last = train.agg(F.max(year)).first()[0]
    early, late = train.where(F.col(year) < last), train.where(F.col(year) == last)
    if early.limit(10).count() < 10:
        early = late = train  # too few rows to hold a year out
    scores, tried = [], families(label, weight)
    seen = Training(early, features, list(tried.values()), apart=True)
    for place, (name, estimator) in enumerate(tried.items()):
        held = predict(seen.fit(estimator), late, features)
        m = held.agg(*(v.alias(k) for k, v in A.regression_metrics(label, "prediction", weight).items())).first()
        scores.append((name, place, m["mae"], m["rmse"], m["r2"], m["rows"]))
    table = train.sparkSession.createDataFrame(scores, "family string, place int, mae double, rmse double, r2 double, rows long")
    name = min(scores, key=lambda s: (s[2], s[1]))[0]
    return name, Training(train, features, list(tried.values()), apart=True).fit(tried[name]), table


def ablations(train: DataFrame, test: DataFrame, features: Features, label: str, weight: str, groups: dict[str, tuple[str, ...]]) -> list[tuple]:
    """(variant, mae) with each group of features left out."""
    out = []
    for name, gone in {"all": (), **groups}.items():
        own = features.without(*gone)
        held = predict(fit(train, own, families(label, weight)["linear"]), test, own)
        out.append((name, held.agg(A.regression_metrics(label, "prediction", weight)["mae"]).first()[0]))
    return out


def importance(model: PipelineModel, features: Features, df: DataFrame) -> list[tuple[str, float]]:
    """Shares of the source features, summed over what was made of each; absolute coefficients where there are no gains."""
    last = model.stages[-1]
    trees = [x.featureImportances.toArray() for x in model.stages if isinstance(x, RandomForestRegressionModel)]  # of one forest, or of trees fitted apart
    if trees:
        gains = sum(trees) / len(trees)
    else:
        gains = last.featureImportances if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients]
    attrs = model.transform(prepared(df.limit(1), features)).schema["features"].metadata["ml_attr"]["attrs"]
    total: dict[str, float] = {}
    for a in (x for kind in attrs.values() for x in kind):
        source = next(f for f in sorted((*features.numeric, *features.categorical), key=len, reverse=True) if a["name"].startswith(f))
        total[source] = total.get(source, 0.0) + float(gains[a["idx"]])
    whole = sum(total.values()) or 1.0
    return sorted(((k, v / whole) for k, v in total.items()), key=lambda x: (-x[1], x[0]))


def risk_classifier(train: DataFrame, features: Features, label: str, classes: int) -> PipelineModel:
    """A forest with balanced class weights; label is an integer from 0."""
    n = train.groupBy(label).agg(F.count("*").alias("_n"))
    total = train.count()
    weighted = train.join(F.broadcast(n), label).withColumn("_w", F.lit(float(total)) / (classes * F.col("_n")))  # a row a class
    return fit(weighted, features, RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="_w", numTrees=20, maxDepth=6, seed=7))


def two_stage(train: DataFrame, features: Features, label: str, weight: str, severe: float):
    """P(severe) times the expected severe value plus P(not) times the median of the others, as a function of rows."""
    flagged = train.withColumn("_severe", (F.col(label) >= severe).cast("int"))
    low = ranks.quantiles(flagged.where("_severe = 0"), label, {"low": 0.5}).first()["low"] or 0.0
    classifier = risk_classifier(flagged, features, "_severe", 2)
    regressor = fit(flagged.where("_severe = 1"), features, families(label, weight)["linear"])

    def apply(df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        p = classifier.transform(prepared(df, features)).withColumn("_p", vector_to_array("probability")[1]).drop("features", "prediction", "probability", "rawPrediction")
        drop = [f"{c}_{k}" for c in features.categorical for k in ("index", "hot")] + [f"{n}_filled" for n in features.numeric]
        both = regressor.transform(p.drop(*drop))
        return both.withColumn("prediction", F.col("_p") * F.col("prediction") + (1 - F.col("_p")) * low).drop("features", *drop)

    return apply


def simplex_grid(parts: int, steps: int = 10) -> list[tuple[float, ...]]:
    """All weights in steps of 1 / steps that sum to 1."""
    def grow(left: int, k: int):
        if k == 1:
            yield (left,)
            return
        for i in range(left + 1):
            yield from ((i, *rest) for rest in grow(left - i, k - 1))

    return [tuple(x / steps for x in w) for w in grow(steps, parts)]


def best_blend(df: DataFrame, predictions: list[str], label: str, weight: str, steps: int = 10) -> DataFrame:
    """One row: the weights of the grid with the least weighted error, the first on ties. All points of the grid are
    aggregates of one pass, so rows are not multiplied."""
    grid = simplex_grid(len(predictions), steps)
    errors = [
        (F.sum(F.col(weight) * F.abs(F.col(label) - sum((F.col(p) * w for p, w in zip(predictions, ws, strict=True)), F.lit(0.0)))) / F.sum(weight)).alias(f"e{i}")
        for i, ws in enumerate(grid)
    ]
    found = df.agg(*errors).select(F.array_sort(F.array(*(F.struct(F.round(f"e{i}", 9).alias("mae"), F.lit(i).alias("i"), F.array(*map(F.lit, ws)).alias("w")) for i, ws in enumerate(grid))))[0].alias("b"))
    return found.select(F.col("b.mae").alias("mae"), *(F.col("b.w")[k].alias(f"w_{p}") for k, p in enumerate(predictions)))


def stacked(train: DataFrame, test: DataFrame, features: Features, label: str, weight: str, year: str) -> DataFrame:
    """Families fitted before the last year, a linear model over their predictions of it, applied to test."""
    last = train.agg(F.max(year)).first()[0]
    tried = families(label, weight)
    seen = Training(train.where(F.col(year) < last), features, list(tried.values()), apart=True)
    models = {n: seen.fit(e) for n, e in tried.items()}

    def layered(df: DataFrame) -> DataFrame:
        for n, m in models.items():
            df = predict(m, df, features, f"p_{n}").drop(*(f"{x}_missing" for x in features.numeric))
        return df

    names = [f"p_{n}" for n in models]
    meta = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), LinearRegression(labelCol=label, weightCol=weight, regParam=0.01)])
    return meta.fit(layered(train.where(F.col(year) == last))).transform(layered(test)).drop("features")


def bands(calibration: DataFrame, label: str, prediction: str, bins: int = 5, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(bin, low, high): residual quantiles of each bin of predictions."""
    edges = A.bin_edges(calibration, prediction, bins)
    rows = calibration.withColumn("bin", A.bin_number(prediction, edges)).withColumn("_r", F.col(label) - F.col(prediction))
    counts = rows.groupBy("bin").agg(F.count("*").alias("rows"))  # a row a bin
    found = ranks.quantiles(rows, "_r", {"low": low, "high": high}, ["bin"])
    return counts.join(found, counts["bin"].eqNullSafe(found["bin"]), "left").select(counts["bin"], "low", "high", "rows")


def survival(df: DataFrame, features: Features, duration: str, observed: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> PipelineModel:
    """Accelerated failure time; observed is 1 where the end is known. Durations must be positive."""
    return fit(df.where(F.col(duration) > 0), features, AFTSurvivalRegression(labelCol=duration, censorCol=observed, quantileProbabilities=list(quantiles), quantilesCol="quantiles", maxIter=30))
