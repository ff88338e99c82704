"""Own stages of ``pyspark.ml``: models whose fit yields tables, kept as Parquet beside their parameters.

They save and load inside a ``PipelineModel``, and so inside a bundle, and need no Python when they are applied: applying
one is a join with its table, which has a row a level (stages x bins, groups) and is broadcast only if Spark finds it small.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.ml import models as M
from tidemark.operators import aggregates as A
from tidemark.operators.tables import stored


class TableWriter(MLWriter):
    def __init__(self, instance: TableModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        tables = self.instance.tables
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"tables": sorted(tables)})
        for name, table in tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class TableReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> TableModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind()
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        model.tables = {name: self.sparkSession.read.parquet(f"{path}/tables/{name}") for name in found["tables"]}
        return model


class TableModel(Model, MLWritable, MLReadable):
    """A model of parameters and tables."""

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.tables = tables or {}

    def write(self) -> TableWriter:
        return TableWriter(self)

    @classmethod
    def read(cls) -> TableReader:
        return TableReader(cls)


def _text(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toString)


def _texts(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toListString)


def _number(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toFloat)


def _numbers(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toListFloat)


class Prepared(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Missing indicators beside numbers, missing categories as one of their own, as a pipeline's first stage."""

    numeric = _texts("numeric", "columns of numbers")
    categorical = _texts("categorical", "columns of categories")
    kept = _texts("kept", "columns that the stages after it need besides")

    def __init__(self, numeric: list[str] | None = None, categorical: list[str] | None = None, kept: list[str] | None = None):
        super().__init__()
        self._setDefault(numeric=[], categorical=[], kept=[])
        self._set(**{k: list(v) for k, v in (("numeric", numeric), ("categorical", categorical), ("kept", kept)) if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return M.prepared(dataset, M.Features(tuple(self.getOrDefault("numeric")), tuple(self.getOrDefault("categorical"))))


class Dropped(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Leaves columns out, if they are there."""

    names = _texts("names", "columns to leave out")

    def __init__(self, names: list[str] | None = None):
        super().__init__()
        self._setDefault(names=[])
        if names is not None:
            self._set(names=list(names))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.getOrDefault("names"))


class Derived(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A column by an SQL expression over the others; columns that may be absent are read as null."""

    name = _text("name", "the column to add or replace")
    expression = _text("expression", "its SQL expression")
    optional = _texts("optional", "columns that the expression reads and that may be absent")

    def __init__(self, name: str | None = None, expression: str | None = None, optional: list[str] | None = None):
        super().__init__()
        self._setDefault(optional=[])
        self._set(**{k: v for k, v in (("name", name), ("expression", expression), ("optional", optional)) if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        absent = [c for c in self.getOrDefault("optional") if c not in dataset.columns]
        found = dataset.withColumns({c: F.lit(None) for c in absent}) if absent else dataset
        return found.withColumn(self.getOrDefault("name"), F.expr(self.getOrDefault("expression"))).drop(*absent)


class _Calibration(Params):
    prediction = _text("prediction", "column that is corrected")
    stage = _text("stage", "column of stages")
    label = _text("label", "column of true values, of which the fit takes the residuals")
    weight = _text("weight", "column of weights")
    least = _number("least", "the least corrected value; none if it isn't set")


class ShrunkCalibration(Estimator, _Calibration, DefaultParamsReadable, DefaultParamsWritable):
    """Learns corrections of predictions from out-of-fold rows: weighted median residuals of bins of predictions, shrunk to
    the overall one, and of stages in bins, shrunk to those, by weight / (weight + strength)."""

    bins = Param(Params._dummy(), "bins", "bins of predictions", TypeConverters.toInt)
    strength = _number("strength", "weight at which a median counts half")

    def __init__(self, prediction: str | None = None, stage: str | None = None, label: str | None = None, weight: str | None = None, bins: int | None = None, strength: float | None = None, least: float | None = None):
        super().__init__()
        self._setDefault(prediction="prediction", bins=5, strength=40.0)
        self._set(**{k: v for k, v in (("prediction", prediction), ("stage", stage), ("label", label), ("weight", weight), ("bins", bins), ("strength", strength), ("least", least)) if v is not None})

    def _fit(self, dataset: DataFrame) -> ShrunkCalibrationModel:
        get = self.getOrDefault
        rows = dataset.withColumn("_residual", F.col(get("label")) - F.col(get("prediction")))
        edges = A.bin_edges(rows, get("prediction"), get("bins"))
        fine, coarse, overall = A.shrunk_levels(rows.withColumn("bin", A.bin_number(get("prediction"), edges)), "_residual", get("stage"), get("weight"), get("strength"))
        found = overall.first()
        tables = {"fine": fine.withColumnRenamed(get("stage"), "stage"), "coarse": coarse}
        model = ShrunkCalibrationModel({name: stored(table, f"calibration-{name}") for name, table in tables.items()})
        model._set(edges=[float(x) for x in edges], overall=float(found[0]) if found and found[0] is not None else 0.0)
        return self._copyValues(model)


class ShrunkCalibrationModel(TableModel, _Calibration):
    edges = _numbers("edges", "inner edges of the bins")
    overall = _number("overall", "correction where neither stage nor bin is known")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        fine = self.tables["fine"].select(F.col("stage").alias("_stage"), F.col("bin").alias("_bin"), F.col("correction").alias("_fine"))
        coarse = self.tables["coarse"].select(F.col("bin").alias("_bin"), F.col("correction").alias("_coarse"))
        rows = dataset.withColumn("_bin", A.bin_number(get("prediction"), get("edges"))).withColumn("_stage", F.col(get("stage")))
        both = rows.join(fine, ["_stage", "_bin"], "left").join(coarse, "_bin", "left")
        new = F.col(get("prediction")) + F.coalesce("_fine", "_coarse", F.lit(get("overall")))
        new = F.when(new.isNotNull(), F.greatest(F.lit(get("least")), new)) if self.isSet("least") else new
        return both.withColumn(get("prediction"), new).drop("_fine", "_coarse", "_bin", "_stage")


class _Prior(Params):
    levels = _texts("levels", "key columns of each level, joined by commas, the finest first")
    label = _text("label", "column of outcomes")
    entity = _text("entity", "column of entities, which count once each")
    year = _text("year", "column of the outcome's year")
    out = _text("out", "column of the prior; its support goes beside it")
    strength = _number("strength", "outcomes that the mean of all counts as in a group's")

    def _levels(self) -> list[list[str]]:
        return [x.split(",") for x in self.getOrDefault("levels")]


class HierarchicalPrior(Estimator, _Prior, DefaultParamsReadable, DefaultParamsWritable):
    """Mean outcomes of groups, one outcome an entity, shrunk to the mean of all: (n * mean + strength * mean of all) /
    (n + strength), for the finest level that has any; else the mean of all.

    The model's ``transform`` is for rows to come and knows all of the fit's outcomes. ``earlier`` is for the rows of the fit
    themselves: each sees only outcomes of strictly earlier years.
    """

    def __init__(self, levels: list[list[str]] | None = None, label: str | None = None, entity: str | None = None, year: str | None = None, out: str | None = None, strength: float | None = None):
        super().__init__()
        self._setDefault(out="prior", strength=20.0)
        joined = [",".join(x) for x in levels] if levels is not None else None
        self._set(**{k: v for k, v in (("levels", joined), ("label", label), ("entity", entity), ("year", year), ("out", out), ("strength", strength)) if v is not None})

    def _outcomes(self, dataset: DataFrame) -> DataFrame:
        """One row an entity: its keys, year and outcome (those of one and the same row, the least)."""
        keys = list(dict.fromkeys(k for x in self._levels() for k in x))
        known = dataset.where(F.col(self.getOrDefault("label")).isNotNull())
        row = F.min(F.struct(F.col(self.getOrDefault("year")).alias("_year"), *keys, F.col(self.getOrDefault("label")).alias("_label"))).alias("_row")
        return known.groupBy(self.getOrDefault("entity")).agg(row).select("_row.*")

    def _fit(self, dataset: DataFrame) -> HierarchicalPriorModel:
        outcomes, k = stored(self._outcomes(dataset), "outcomes"), self.getOrDefault("strength")
        found = outcomes.agg(F.avg("_label")).first()[0]
        overall = float(found) if found is not None else 0.0
        value = ((F.sum("_label") + k * overall) / (F.count("*") + k)).alias("value")
        levels = [outcomes.groupBy(*keys).agg(value, F.count("*").alias("support")) for keys in self._levels()]
        model = HierarchicalPriorModel({f"level{i}": stored(level, "prior") for i, level in enumerate(levels)})
        model._set(overall=overall)
        return self._copyValues(model)

    def earlier(self, dataset: DataFrame) -> DataFrame:
        """dataset with the prior of strictly earlier years; a row of the first year, or of none, has 0 and no support."""
        outcomes, out, year = stored(self._outcomes(dataset), "outcomes"), self.getOrDefault("out"), self.getOrDefault("year")
        found = dataset
        for i, keys in enumerate([*self._levels(), []]):
            # A row a group and year that asks, or has outcomes: sums of all earlier years, also for years without outcomes.
            facts = outcomes.where("_year IS NOT NULL").groupBy(*keys, "_year").agg(F.sum("_label").alias("_s"), F.count("*").alias("_n"))
            asked = dataset.where(F.col(year).isNotNull()).select(*keys, F.col(year).alias("_year")).distinct().withColumns({"_s": F.lit(0.0), "_n": F.lit(0)})
            daily = facts.unionByName(asked).groupBy(*keys, "_year").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
            before = Window.partitionBy(*keys).orderBy("_year").rangeBetween(Window.unboundedPreceding, -1)  # a row a year
            prior = daily.select(
                *(F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)), F.col("_year").alias("_y"),
                F.sum("_s").over(before).alias(f"_sum{i}"), F.sum("_n").over(before).alias(f"_support{i}"),
            ).where(F.col(f"_support{i}") > 0)
            same = F.col(year) == F.col("_y")
            for j, k in enumerate(keys):
                same &= F.col(k).eqNullSafe(F.col(f"_k{j}"))
            found = found.join(prior, same, "left").drop("_y", *(f"_k{j}" for j in range(len(keys))))
        n, k = len(self._levels()), self.getOrDefault("strength")
        overall = F.col(f"_sum{n}") / F.col(f"_support{n}")
        value = F.coalesce(*((F.col(f"_sum{i}") + k * overall) / (F.col(f"_support{i}") + k) for i in range(n)), overall, F.lit(0.0))
        # The mean of all supports nothing in particular: its support counts as none.
        support = F.coalesce(*(F.col(f"_support{i}") for i in range(n)), F.lit(0))
        return found.withColumns({out: value, f"{out}_support": support.cast("long")}).drop(*(f"_{c}{i}" for c in ("sum", "support") for i in range(n + 1)))


class HierarchicalPriorModel(TableModel, _Prior):
    overall = _number("overall", "the mean of all outcomes")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found, out, levels = dataset, self.getOrDefault("out"), self._levels()
        for i, keys in enumerate(levels):
            table = self.tables[f"level{i}"].select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)), F.col("value").alias(f"_value{i}"), F.col("support").alias(f"_support{i}"))
            same = F.lit(True)
            for j, k in enumerate(keys):
                same &= F.col(k).eqNullSafe(F.col(f"_k{j}"))
            found = found.join(table, same, "left").drop(*(f"_k{j}" for j in range(len(keys))))
        value = F.coalesce(*(F.col(f"_value{i}") for i in range(len(levels))), F.lit(self.getOrDefault("overall")))
        support = F.coalesce(*(F.col(f"_support{i}") for i in range(len(levels))), F.lit(0))
        return found.withColumns({out: value, f"{out}_support": support.cast("long")}).drop(*(f"_{c}{i}" for c in ("value", "support") for i in range(len(levels))))
