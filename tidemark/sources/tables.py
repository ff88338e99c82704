"""Readers and writers of the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.sources.schemas import OUTCOME, PROJECT, SNAPSHOT, columns


def _exists(spark: SparkSession, path: str) -> bool:
    """By the session's own file systems, so any store that Spark reads will do."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def first_existing(spark: SparkSession, *paths: str) -> str:
    for path in paths:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, or its .gz, read as text and coerced: what doesn't fit its type is null, never an error. Ids
    stay text. A packed file can't be split, so its rows are dealt out again."""
    found = first_existing(spark, path, f"{path}.gz")
    raw = spark.read.option("header", True).csv(found)
    out = raw.select(*((F.col(c) if c in raw.columns else F.lit(None)).try_cast(kind).alias(c) for c, kind in columns(schema).items()))
    return out.repartition(spark.sparkContext.defaultParallelism) if found.endswith(".gz") else out


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SNAPSHOT)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, OUTCOME)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PROJECT)


def _typed(spark: SparkSession, path: str, ids: tuple[str, ...], dates: tuple[str, ...]) -> DataFrame:
    """A CSV with a header: ids stay text, what isn't a date is null, and the other columns get the types that all their
    values have."""
    found = first_existing(spark, path, f"{path}.gz")
    seen = spark.read.option("header", True).option("inferSchema", True).csv(found).schema
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name in (*ids, *dates) else f.dataType) for f in seen])
    raw = spark.read.option("header", True).schema(as_text).csv(found)
    lacking = [c for c in (*ids, *dates) if c not in raw.columns]
    if lacking:
        raise ValueError(f"{found} lacks {lacking}")
    return raw.withColumns({c: F.to_date(F.coalesce(F.try_to_timestamp(F.trim(c)), F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd")))) for c in dates})


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Monthly histories of works: the snapshot's and the revised completion's day, and whatever else the file tells."""
    return _typed(spark, path, ("project_code",), ("snapshot_date", "revised_completion_date"))


#: The days that a demonstration history tells.
DEMO_DATES = ("month", "start_date", "planned_completion_date", "revised_completion_date", "actual_completion_date")


def read_demo_history(spark: SparkSession, path: str, dates: tuple[str, ...] = DEMO_DATES) -> DataFrame:
    return _typed(spark, path, ("project_id",), dates)


def read_artifacts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(run, key, value) of the JSON objects called ``name`` in the folders under ``root``, one a run; values that are objects or
    lists stay JSON. A file that holds no object has no rows."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
    run = F.element_at(F.split(F.input_file_name(), "/"), -2)
    told = files.select(run.alias("run"), F.from_json("value", "map<string,string>").alias("told"))
    return told.select("run", F.explode("told").alias("key", "value"))


#: Names under which scored rows may lie in a model's folder, in order; what their columns are called elsewhere.
VALIDATION_FILES = ("prediction_validation.csv", "prediction_validation.csv.gz", "evaluation_results.csv")
VALIDATION_NAMES = {"canonical_project_id": "project_id", "actual_cost_overrun_percentage": "actual_cost_overrun"}
VALIDATION_OPTIONAL = ("predicted_cost_p10", "predicted_cost_p90", "predicted_delay_p10", "predicted_delay_p90", "model_confidence_percentage")


def read_validation(spark: SparkSession, folder: str | None, legacy: str | None = None) -> DataFrame:
    """Scored rows of a model's folder under the common names, optional columns null where they are missing. Without a folder,
    or if the folder has none of the files and a legacy file is given, those of the legacy file."""
    places = [f"{folder.rstrip('/')}/{n}" for n in VALIDATION_FILES] if folder else []
    path = first_existing(spark, *places, *([legacy] if legacy else []))
    rows = spark.read.option("header", True).csv(path)
    taken = {a: b for a, b in VALIDATION_NAMES.items() if a in rows.columns and b not in rows.columns}
    rows = rows.withColumnsRenamed(taken)
    text = {c for c in rows.columns if c == "project_id" or c.endswith(("_id", "_name", "_date")) or c in ("stage", "sector", "lifecycle_stage")}
    rows = rows.select(*(F.col(c) if c in text else _number_or_text(rows, c) for c in rows.columns))
    return rows.withColumns({c: F.lit(None).cast("double") for c in VALIDATION_OPTIONAL if c not in rows.columns})


def _number_or_text(rows: DataFrame, name: str) -> Column:
    """Predicted and actual values, errors and shares are numbers; a cell that isn't one is null."""
    number = name.startswith(("predicted_", "actual_", "model_confidence")) or name.endswith(("_error", "_percentage", "_overrun", "_days", "weight"))
    return F.col(name).try_cast("double").alias(name) if number else F.col(name)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of report entries, one row each."""
    return spark.read.option("multiLine", True).json(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of each file, and whether it starts as a PDF does."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Runs under a folder: run, how many files it has, whether a manifest and a marker of training are among them, and
    the status that follows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    inside = F.regexp_replace("path", ".*" + r"/\Q" + root.rstrip("/").rsplit("/", 1)[-1] + r"\E/", "")
    parts = files.select(F.split(inside, "/")[0].alias("run"), F.element_at(F.split("path", "/"), -1).alias("file"))
    runs = parts.groupBy("run").agg(
        F.count("*").alias("files"), F.max((F.col("file") == "manifest.json").cast("int")).alias("manifest"), F.max((F.col("file") == ".training").cast("int")).alias("training")
    )
    return runs.withColumn("status", F.when(F.col("training") == 1, "training").when(F.col("manifest") == 1, "ready").otherwise("incomplete"))


def new_only(found: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What isn't done yet, by content hash and parser version."""
    return found.join(done.select(*key).distinct(), key, "left_anti")


def merged_manifest(previous: DataFrame, current: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """The current entries, with the carried columns of the previous ones where they lack their own."""
    old = previous.select(*key, *(F.col(c).alias(f"_old_{c}") for c in carried if c in previous.columns))
    out = current.join(old, key, "left")
    for c in carried:
        if f"_old_{c}" in out.columns:
            out = out.withColumn(c, F.coalesce(c, f"_old_{c}") if c in current.columns else F.col(f"_old_{c}"))
    return out.drop(*(f"_old_{c}" for c in carried))


def month_spine(spark: SparkSession, entities: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each entity and month from its start to its end."""
    return entities.withColumn("month", F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))))


def synthetic_histories(spark: SparkSession, entities: int, months: int, first: str = "2015-04-01") -> DataFrame:
    """Deterministic demonstration series: progress with a wobble, costs that rise for some entities."""
    base = spark.range(entities).select(F.col("id").cast("string").alias("project_id"), F.col("id").alias("i"), (100.0 + (F.col("id") % 17) * 25).alias("original_cost"))
    base = base.withColumn("s", F.lit(first).cast("date")).withColumn("e", F.add_months("s", months - 1))
    spine = month_spine(spark, base, "s", "e").withColumn("k", F.months_between("month", "s").cast("int"))
    share = (F.col("k") + 1) / months
    late = (F.col("i") % 4 == 0).cast("double")
    progress = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * share - 12 * late * share + 2 * F.sin(F.col("k") + F.col("i"))))
    cost = F.col("original_cost") * (1 + 0.4 * late * share)
    return spine.select("project_id", "month", "original_cost", F.round(cost, 4).alias("current_estimated_cost"), F.round(progress, 4).alias("physical_progress_percentage"), F.round(cost * progress / 100, 4).alias("actual_cost"))


def write_table(df: DataFrame, path: str, partition: str | None = None, only_if_absent: bool = False) -> None:
    """Parquet, by default refusing to overwrite."""
    writer = df.write.mode("ignore" if only_if_absent else "errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_csv(df: DataFrame, path: str, only_if_absent: bool = False) -> None:
    df.write.mode("ignore" if only_if_absent else "errorifexists").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def strict_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, with NaN and infinities as null."""
    def clean(name, kind):
        x = F.col(name)
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(name) if kind in ("double", "float") else x

    return df.select(F.to_json(F.struct(*(clean(n, k) for n, k in df.dtypes)), {"ignoreNullFields": "false"}).alias("json"))
