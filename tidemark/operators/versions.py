"""Logs that only grow: numbered entries that exist once, reads pinned to a number, and contexts frozen under their digest.

An entry is created only if its number is free, so of two writers that follow the same entry one wins and the other is told.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F


class Conflict(RuntimeError):
    """Another writer took the number."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole, or returns False if there is one. A local folder gets a link to a finished file, which exists
    at once or not at all; other stores create without overwriting."""
    where, fs = _fs(spark, path)
    if str(fs.getUri()).startswith("file:"):
        own = unquote(urlparse(path).path)
        os.makedirs(os.path.dirname(own), exist_ok=True)
        draft = f"{own}.{uuid.uuid4().hex}.draft"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, own)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    if fs.exists(where):
        return False
    try:
        out = fs.create(where, False)
    except Exception as e:
        if fs.exists(where):
            return False
        raise OSError(f"can't create {path}") from e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _names(spark: SparkSession, root: str) -> list[str]:
    where, fs = _fs(spark, root)
    return sorted(n for x in fs.listStatus(where) if (n := x.getPath().getName()).endswith(".json")) if fs.exists(where) else []


def head(spark: SparkSession, root: str) -> int:
    """The number of the last entry; 0 if there is none."""
    names = _names(spark, root)
    return int(names[-1].removesuffix(".json")) if names else 0


def commit(spark: SparkSession, root: str, entry: dict, after: int) -> int:
    """Adds an entry behind number ``after`` and returns its number. Entries that would leave a gap are refused."""
    if after > head(spark, root):
        raise ValueError(f"{root} has no entry {after}")
    number = after + 1
    text = json.dumps({"number": number} | entry, sort_keys=True, allow_nan=False)
    if not create(spark, f"{root.rstrip('/')}/{number:012d}.json", text):
        raise Conflict(f"{root} has an entry {number} by now")
    return number


def append(spark: SparkSession, root: str, entry: dict, tries: int = 100) -> int:
    """Adds an entry wherever the log ends: for entries that don't depend on what stands before them."""
    for _ in range(tries):
        try:
            return commit(spark, root, entry, head(spark, root))
        except Conflict:
            continue
    raise Conflict(f"{root} grows too fast")


def entries(spark: SparkSession, root: str, upto: int | None = None) -> list[dict]:
    """The entries up to a number, the last one by default: later entries change nothing for a pinned reader."""
    names = [n for n in _names(spark, root) if upto is None or int(n.removesuffix(".json")) <= upto]
    if not names:
        return []
    lines = spark.read.text([f"{root.rstrip('/')}/{n}" for n in names], wholetext=True).collect()  # one a version
    return sorted((json.loads(r[0]) for r in lines), key=lambda e: e["number"])


def read(spark: SparkSession, root: str, number: int) -> dict:
    found = [e for e in entries(spark, root, number) if e["number"] == number]
    if not found:
        raise KeyError(f"{root} has no entry {number}")
    return found[0]


def table_at(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The rows of a versioned table (``add_rows``) as of a version, each with its number as ``version``."""
    found = entries(spark, root.rstrip("/") + "/log", number)
    if not found:
        raise KeyError(f"{root} has no version")
    parts = [spark.read.parquet(e["path"]).withColumn("version", F.lit(e["number"])) for e in found]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def add_rows(df: DataFrame, root: str, entry: dict | None = None, after: int | None = None) -> int:
    """Writes df beside the table and then commits it as its next version: readers see it whole or not at all. ``after`` makes
    it depend on what the writer has read."""
    spark, root = df.sparkSession, root.rstrip("/")
    path = f"{root}/rows/{uuid.uuid4().hex}"
    df.write.parquet(path)
    told = (entry or {}) | {"path": path}
    return append(spark, f"{root}/log", told) if after is None else commit(spark, f"{root}/log", told, after)


def fingerprint(context: dict) -> str:
    return hashlib.sha256(json.dumps(context, sort_keys=True, allow_nan=False).encode()).hexdigest()


def freeze(spark: SparkSession, root: str, context: dict) -> str:
    """Stores a context (data, cohort, features, window, metric, ...) under its digest and returns that. Freezing the same again
    changes nothing."""
    mark = fingerprint(context)
    create(spark, f"{root.rstrip('/')}/{mark}.json", json.dumps(context, sort_keys=True, allow_nan=False))
    return mark


def require_frozen(spark: SparkSession, root: str, mark: str, context: dict) -> None:
    """An error, naming what differs, unless the context under ``mark`` is the given one and is as it was frozen."""
    where, fs = _fs(spark, path := f"{root.rstrip('/')}/{mark}.json")
    if not fs.exists(where):
        raise KeyError(f"no context {mark}")
    kept = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if fingerprint(kept) != mark:
        raise ValueError(f"{path} was changed")
    if kept != context:
        raise ValueError(f"contexts differ in {sorted(k for k in {*kept, *context} if kept.get(k) != context.get(k))}")
