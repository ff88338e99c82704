"""Hide, predict, reveal: held-out rows whose outcomes stay hidden until a prediction is on record.

A session is a folder with the tables ``rows`` (what may be seen), ``outcomes`` and ``predictions``, so it outlives the
process that opened it. Predictions are versions of a table that only grows: an entity's first one counts, whatever is said
later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import versions
from tidemark.operators.windows import latest


class Session:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, history: DataFrame, path: str, key: str, day: str, ended: str, outcomes: list[str]) -> Session:
        """Keeps each entity's latest row before its end."""
        own = cls(history.sparkSession, path)
        rows = latest(history.where(F.col(day) < F.col(ended)), key, day, day).withColumnRenamed(key, "entity")
        rows.drop(*outcomes, ended).write.mode("errorifexists").parquet(f"{own.path}/rows")
        rows.select("entity", *outcomes).write.mode("errorifexists").parquet(f"{own.path}/outcomes")
        return own

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def predict(self, predictions: DataFrame) -> None:
        """(entity, predicted) rows, one an entity."""
        known = predictions.join(self.rows().select("entity"), "entity", "left_semi").select("entity", "predicted")
        twice = known.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").first()
        if twice:
            raise ValueError(f"{twice['entity']} is predicted {twice['n']} times at once")
        versions.add_rows(known, f"{self.path}/predictions")

    def reveal(self) -> DataFrame:
        """Outcomes of the entities that have a prediction; an error before any has one."""
        if not versions.head(self.spark, f"{self.path}/predictions/log"):
            raise PermissionError("predict before you reveal")
        every = versions.table_at(self.spark, f"{self.path}/predictions")
        said = every.groupBy("entity").agg(F.min_by("predicted", "version").alias("predicted"))
        return said.join(self.spark.read.parquet(f"{self.path}/outcomes"), "entity")
