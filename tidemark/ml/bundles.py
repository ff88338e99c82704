"""Fitted models as folders with provenance, and a registry of runs that only grows.

A bundle holds ``models/<name>``, ``metadata`` and ``manifest``; the manifest is written last and tells the digests of all
files under ``models``. Everything goes through Spark's file systems, so bundles may lie on any of them.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.ml.models import Features, predict
from tidemark.operators import governance as G
from tidemark.operators import windows as W


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One line of strict JSON; a path that exists is an error."""
    text = json.dumps(value, sort_keys=True, allow_nan=False)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def digest(spark: SparkSession, path: str) -> str:
    """Of the names and contents of all files under a folder, wherever it lies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select(name.alias("name"), F.sha2("content", 256).alias("content")).transform(G.fingerprint).first()["digest"]


def save(spark: SparkSession, models: dict[str, PipelineModel], metadata: dict, path: str, run: str, dataset: str, features: list[str], sources: dict[str, str] | None = None) -> dict:
    """Writes a bundle beside ``path``, then puts it there in the place of an older one. Returns the manifest."""
    if not models:
        raise ValueError("a bundle without models")
    staged = path.rstrip("/") + f".staged-{run}"
    where, fs = _fs(spark, staged)
    fs.delete(where, True)
    for name, model in models.items():
        model.write().save(f"{staged}/models/{name}")
    own = {"run": run, "dataset": dataset}
    manifest = own | {
        "status": "complete", "features": G.schema_fingerprint(features), "sources": sources or {}, "models": {n: digest(spark, f"{staged}/models/{n}") for n in sorted(models)}
    }
    write_json(spark, metadata | own | {"features": list(features)}, f"{staged}/metadata")
    write_json(spark, manifest, f"{staged}/manifest")
    G.publish(spark, staged, path)
    return manifest


def check(spark: SparkSession, path: str, required: tuple[str, ...] = (), sources: dict[str, str] | None = None) -> tuple[dict, dict]:
    """(metadata, manifest) of a bundle, or an error that says why it isn't to be used: it isn't complete, its parts are of
    different runs, datasets or features, a model is missing or was changed, or a source is another one by now."""
    if not exists(spark, f"{path}/manifest") or not exists(spark, f"{path}/metadata"):
        raise ValueError(f"{path} has no provenance")
    metadata, manifest = read_json(spark, f"{path}/metadata"), read_json(spark, f"{path}/manifest")
    faults = [] if manifest.get("status") == "complete" else [f"status {manifest.get('status')}"]
    faults += [f"{k} differs or is missing" for k in ("run", "dataset") if not manifest.get(k) or manifest.get(k) != metadata.get(k)]
    if manifest.get("features") != G.schema_fingerprint(metadata.get("features") or []):
        faults.append("features differ")
    models = manifest.get("models") or {}
    faults += [f"model {n} is missing" for n in required if n not in models]
    for name, mark in models.items():
        folder = f"{path}/models/{name}"
        if not exists(spark, folder):
            faults.append(f"model {name} is missing")
        elif digest(spark, folder) != mark:
            faults.append(f"model {name} was changed")
    known = manifest.get("sources") or {}
    faults += [f"source {k} was changed" for k, v in (sources or {}).items() if k in known and known[k] != v]
    if faults:
        raise ValueError(f"{path}: " + "; ".join(faults))
    return metadata, manifest


def load(spark: SparkSession, path: str, required: tuple[str, ...] = (), sources: dict[str, str] | None = None) -> tuple[dict[str, PipelineModel], dict]:
    """Models by name, and the metadata, of a bundle that passes ``check``."""
    metadata, manifest = check(spark, path, required, sources)
    return {n: PipelineModel.load(f"{path}/models/{n}") for n in manifest["models"]}, metadata


def replaced(spark: SparkSession, path: str, name: str, model: PipelineModel, metadata: dict, manifest: dict, run: str) -> dict:
    """Puts a model in the place of another in a bundle, as a new run, and returns the manifest. The other models' files are
    copied as they are; that they still have the digests of the old manifest is checked before the bundle is published."""
    staged = path.rstrip("/") + f".staged-{run}"
    (where, fs), (source, _) = _fs(spark, staged), _fs(spark, path)
    fs.delete(where, True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, where, False, spark._jsc.hadoopConfiguration())
    for part in (f"models/{name}", "metadata", "manifest"):
        fs.delete(_fs(spark, f"{staged}/{part}")[0], True)
    model.write().save(f"{staged}/models/{name}")
    marks = {n: digest(spark, f"{staged}/models/{n}") for n in sorted(manifest["models"])}
    changed = [n for n, mark in marks.items() if n != name and mark != manifest["models"][n]]
    if changed:
        raise ValueError(f"{staged}: {changed} were changed")
    write_json(spark, metadata | {"run": run}, f"{staged}/metadata")
    new = manifest | {"run": run, "models": marks, "previous_run": manifest["run"]}
    write_json(spark, new, f"{staged}/manifest")
    G.publish(spark, staged, path)
    return new


def forecast(spark: SparkSession, path: str, history: DataFrame, features: Features, entity: str, day: str, tie: str, sources: dict[str, str] | None = None) -> DataFrame:
    """The last row of each entity with ``predicted_<name>`` of each model of a bundle, and the run that they are of."""
    models, metadata = load(spark, path, (), sources)
    rows = W.latest(history, entity, day, tie)
    for name, model in models.items():
        rows = predict(model, rows, features, f"predicted_{name}").drop(*(f"{x}_missing" for x in features.numeric))
    return rows.withColumn("run", F.lit(metadata["run"]))


#: What an entry must tell, and what may have been decided.
ENTRY, DECISIONS = ("experiment", "run", "recorded_at", "decision"), ("promote", "reject", "hold")


def record(spark: SparkSession, entry: dict, root: str) -> str:
    """Stores a run under ``root``, one folder each, and returns it. The same entry may be stored again; another one for the
    same run is an error."""
    if missing := [k for k in ENTRY if not entry.get(k)]:
        raise ValueError(f"an entry lacks {missing}")
    if entry["decision"] not in DECISIONS:
        raise ValueError(f"{entry['decision']} is none of {DECISIONS}")
    for k in ("experiment", "run"):
        if not str(entry[k]).replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"{entry[k]!r} can't name a folder")
    path = f"{root.rstrip('/')}/experiment={entry['experiment']}/run={entry['run']}"
    if not exists(spark, path):
        write_json(spark, entry, path)
    elif read_json(spark, path) != json.loads(json.dumps(entry)):
        raise ValueError(f"{path} holds another entry")
    return path


def entries(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All entries under ``root``, as rows of the given schema; ``governance.decisions`` takes them from there."""
    return spark.read.option("recursiveFileLookup", "true").schema(schema).json(root)
