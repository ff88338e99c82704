"""Provenance: fingerprints of tables that no order or partitioning changes, evidence ledgers, publishing, registries."""

from __future__ import annotations

import hashlib
import importlib
import inspect
import json
import pkgutil
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# How a cell is written before it is hashed.
_MISSING, _FLOAT, _DATE = "<NA>", "%.12g", "yyyy-MM-dd'T'HH:mm:ss"


def canonical_cell(name: str, kind: str) -> Column:
    x = F.col(name)
    if kind in ("double", "float"):
        text = F.format_string(_FLOAT, x)
    elif kind.startswith(("timestamp", "date")):
        text = F.date_format(x, _DATE)
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit(_MISSING))


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    kinds = dict(df.dtypes)
    return F.sha2(F.concat_ws("\x1f", *(canonical_cell(c, kinds[c]) for c in sorted(columns))), 256)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows and a digest that depends on the multiset of rows alone.

    Two sums of 48 bits of each row's SHA-256 are combined on the map side, so no task sees more than its own rows. That
    tells tables apart by chance of 2^-96, but is not made to withstand crafted collisions.
    """
    columns = columns or df.columns
    h = row_digest(df, columns)
    part = lambda i: F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")
    total = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part(1)), F.lit(0)).alias("a"), F.coalesce(F.sum(part(13)), F.lit(0)).alias("b"))
    seed = F.concat_ws("|", F.lit(",".join(sorted(columns))), F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return total.select("rows", F.sha2(seed, 256).alias("digest"))


def schema_fingerprint(features: list[str]) -> str:
    """Of an ordered list of names."""
    return hashlib.sha256(json.dumps(list(features)).encode()).hexdigest()


#: The key of an evidence row, and what it holds.
LEDGER_KEY = ("entity", "as_of")
LEDGER = (*LEDGER_KEY, "stage", "sector", "weight", "actual", "baseline", "challenger")


def ledger(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Paired evidence rows with absolute errors and improvement, in the ledger's column order."""
    missing = [c for c in (*LEDGER, *extra) if c not in rows.columns]
    if missing:
        raise ValueError(f"a ledger lacks {missing}")
    base, new = F.abs(F.col("baseline") - F.col("actual")), F.abs(F.col("challenger") - F.col("actual"))
    return rows.select(*LEDGER, *extra, base.alias("baseline_error"), new.alias("challenger_error"), (base - new).alias("improvement"))


def ledger_faults(book: DataFrame) -> DataFrame:
    """Counts of what a valid ledger has none of, in one row: doubled keys, missing values, weights that aren't positive."""
    per_key = book.groupBy(*LEDGER_KEY).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("actual").isNull() | F.col("baseline").isNull() | F.col("challenger").isNull(), 1)).alias("m"),
        F.count(F.when(~F.coalesce(F.col("weight") > 0, F.lit(False)), 1)).alias("w"),
    )
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0)).alias("doubled"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing"), F.coalesce(F.sum("w"), F.lit(0)).alias("bad_weight")
    )


def write_ledger(book: DataFrame, path: str) -> dict:
    """Checks, writes once (an existing ledger is an error) and returns the manifest."""
    faults = book.transform(ledger_faults).first().asDict()
    if any(faults.values()):
        raise ValueError(f"not a valid ledger: {faults}")
    book.write.mode("errorifexists").parquet(path)
    stored = book.sparkSession.read.parquet(path)
    mark = stored.transform(fingerprint).first()
    return {"path": path, "rows": mark["rows"], "digest": mark["digest"], "columns": stored.columns, "cohort": cohort(stored)}


def cohort(book: DataFrame) -> str:
    """A digest of who is in it and with what weight, whatever was predicted."""
    return fingerprint(book, [*LEDGER_KEY, "weight"]).first()["digest"]


def same_cohort(a: DataFrame, b: DataFrame) -> bool:
    return cohort(a) == cohort(b)


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """Puts a staged folder in the place of the final one: old out of the way, new in, old back if that fails."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    a, b, backup = path(staged), path(final), path(final.rstrip("/") + ".previous")
    fs = b.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(a):
        raise FileNotFoundError(staged)
    fs.delete(backup, True)
    had = fs.exists(b)
    if had and not fs.rename(b, backup):
        raise OSError(f"can't move {final}")
    if not fs.rename(a, b):
        if had:
            fs.rename(backup, b)
        raise OSError(f"can't publish {staged}")
    fs.delete(backup, True)


@dataclass(frozen=True)
class RunContext:
    """What two runs must share to be compared."""

    dataset: str
    cohort: str
    features: str
    window: tuple[int, int, int, int]

    def require_same(self, other: RunContext) -> None:
        if self != other:
            raise ValueError(f"runs differ in {[k for k in self.__dataclass_fields__ if getattr(self, k) != getattr(other, k)]}")


def decisions(runs: DataFrame, least_gain: float = 10.0) -> DataFrame:
    """The latest entry of each (experiment, run), and whether its gain in per cent suffices to promote it."""
    from tidemark.operators.windows import pick

    last = pick(runs, ["experiment", "run"], [F.desc("recorded_at")])
    gain = F.when(F.col("baseline") != 0, (F.col("baseline") - F.col("challenger")) / F.col("baseline") * 100)
    return last.withColumn("gain", gain).withColumn("promote", F.coalesce(gain >= least_gain, F.lit(False)))


class Registry:
    """Named extensions, tried in order of registration; a name can be taken once."""

    def __init__(self, *required: str):
        self.required, self._found = required, {}

    def add(self, name: str, extension) -> None:
        if name in self._found:
            raise ValueError(f"{name} is registered already")
        if missing := [r for r in self.required if not callable(getattr(extension, r, None))]:
            raise TypeError(f"{name} lacks {missing}")
        self._found[name] = extension

    def discover(self, package: str, prefix: str, opt_in: str) -> list[str]:
        """Registers the modules of a package whose name has the prefix and that say so themselves: ``opt_in`` must be True, a
        name alone is not enough. A module names itself by ``NAME``. Returns the new names, in order of ``SEQUENCE``, then name."""
        found = []
        for item in pkgutil.iter_modules(importlib.import_module(package).__path__):
            if item.name.startswith(prefix):
                module = importlib.import_module(f"{package}.{item.name}")
                if getattr(module, opt_in, False) is True:
                    if not getattr(module, "NAME", None):
                        raise TypeError(f"{module.__name__} lacks a name")
                    found.append((getattr(module, "SEQUENCE", 0), module.NAME, module))
        for _, name, module in sorted(found, key=lambda x: x[:2]):
            self.add(name, module)
        return [name for _, name, _ in sorted(found, key=lambda x: x[:2])]

    def __iter__(self):
        return iter(self._found.items())

    def __getitem__(self, name: str):
        return self._found[name]


def load_callable(spec: str, allowed: tuple[str, ...]) -> Callable:
    """``package.module:function`` from a package on the allow-list, or below one; anything else is refused before it is
    imported."""
    if not re.fullmatch(r"[a-z_][a-z0-9_]*(\.[a-z_][a-z0-9_]*)*:[a-z_][a-z0-9_]*", spec):
        raise ValueError(f"{spec!r} isn't package.module:function")
    module, name = spec.split(":")
    if not any(module == a or module.startswith(a + ".") for a in allowed):
        raise ValueError(f"{module} isn't allowed")
    found = getattr(importlib.import_module(module), name, None)
    if not callable(found) or getattr(found, "__module__", None) != module:
        raise ValueError(f"{spec} is no function of that module")
    return found


def invoke(function: Callable, available: dict):
    """Calls a function with those of the available arguments that it names; one that needs others is refused."""
    wanted = inspect.signature(function).parameters
    named = (inspect.Parameter.POSITIONAL_OR_KEYWORD, inspect.Parameter.KEYWORD_ONLY)
    lacking = [n for n, p in wanted.items() if n not in available and p.default is inspect.Parameter.empty and p.kind not in (inspect.Parameter.VAR_POSITIONAL, inspect.Parameter.VAR_KEYWORD)]
    lacking += [n for n, p in wanted.items() if n in available and p.kind is inspect.Parameter.POSITIONAL_ONLY]
    if lacking:
        raise ValueError(f"{function.__name__} needs {', '.join(lacking)}")
    return function(**{n: available[n] for n, p in wanted.items() if n in available and p.kind in named})
