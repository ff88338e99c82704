"""Parsed rows kept by what was parsed: by the digest of the content and the parser's name and version.

A run parses only contents that no committed batch holds, writes its rows and the list of its digests, and then adds one entry
to the log. A run that dies before that leaves files that no reader looks at; a second run over the same files parses nothing.
Of batches that hold the same digest, as of two runs at once, the earlier one counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import versions


def _home(root: str, parser: str, version: str) -> str:
    for name in (parser, version):
        if not name.replace("-", "").replace("_", "").replace(".", "").isalnum():
            raise ValueError(f"{name!r} can't name a folder")
    return f"{root.rstrip('/')}/parser={parser}/version={version}"


def _batches(spark: SparkSession, home: str) -> list[dict]:
    """Committed batches that none of later ones replaces, in order."""
    found = versions.entries(spark, f"{home}/log")
    gone = {b for e in found for b in e.get("replaces", [])}
    return [e for e in found if e["batch"] not in gone]


def _owners(spark: SparkSession, home: str, batches: list[dict]) -> DataFrame | None:
    """(digest, batch): each digest with the first batch that holds it."""
    if not batches:
        return None
    parts = [spark.read.parquet(f"{home}/batch={b['batch']}/digests").select("digest", F.lit(i).alias("place"), F.lit(b["batch"]).alias("batch")) for i, b in enumerate(batches)]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.groupBy("digest").agg(F.min_by("batch", "place").alias("batch"))


def parse_new(files: DataFrame, parse: Callable[[DataFrame], DataFrame], root: str, parser: str, version: str) -> int:
    """Parses those of ``files`` (digest, and what ``parse`` needs) that aren't kept yet, and returns how many those were.

    ``parse`` gives rows that have the file's ``digest``; a file may give none. Several files of one digest are parsed once.
    """
    spark, home = files.sparkSession, _home(root, parser, version)
    fresh = files.where(F.col("digest").isNotNull()).dropDuplicates(["digest"])
    owners = _owners(spark, home, _batches(spark, home))
    if owners is not None:
        fresh = fresh.join(owners.select("digest"), "digest", "left_anti")
    batch = uuid.uuid4().hex
    fresh.select("digest").write.parquet(f"{home}/batch={batch}/digests")
    digests = spark.read.parquet(f"{home}/batch={batch}/digests")
    n = digests.count()
    if n:
        parse(files.where(F.col("digest").isNotNull()).dropDuplicates(["digest"]).join(digests, "digest", "left_semi")).write.parquet(f"{home}/batch={batch}/rows")
        versions.append(spark, f"{home}/log", {"batch": batch, "files": n})
    return n


def parsed(spark: SparkSession, root: str, parser: str, version: str, digests: DataFrame | None = None) -> DataFrame | None:
    """The kept rows, of the given digests if any are given; None before the first batch."""
    home = _home(root, parser, version)
    batches = _batches(spark, home)
    owners = _owners(spark, home, batches)
    if owners is None:
        return None
    parts = [spark.read.parquet(f"{home}/batch={b['batch']}/rows").withColumn("_batch", F.lit(b["batch"])) for b in batches]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    own = rows.join(owners.withColumnRenamed("batch", "_batch"), ["digest", "_batch"], "left_semi").drop("_batch")
    return own if digests is None else own.join(digests.select("digest"), "digest", "left_semi")


def compact(spark: SparkSession, root: str, parser: str, version: str) -> int:
    """Writes all batches as one that replaces them, and returns how many it replaced. Readers that began before go on with
    the old ones, whose files stay."""
    home = _home(root, parser, version)
    batches = _batches(spark, home)
    if len(batches) < 2:
        return 0
    batch = uuid.uuid4().hex
    _owners(spark, home, batches).select("digest").write.parquet(f"{home}/batch={batch}/digests")
    parsed(spark, root, parser, version).write.parquet(f"{home}/batch={batch}/rows")
    versions.append(spark, f"{home}/log", {"batch": batch, "files": sum(b["files"] for b in batches), "replaces": [b["batch"] for b in batches]})
    return len(batches)
