"""Experiments as graphs of stages whose outputs are kept under the fingerprint of all that they depend on.

A stage's fingerprint covers its name, its function's code, its parameters and the fingerprints of what it needs, so changing
one stage runs that and what follows it; everything else is read back. An output counts once its marker exists, which is
written last: a run that died leaves nothing that a later one would take.
"""

from __future__ import annotations

import inspect
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import governance as G
from tidemark.operators import versions


@dataclass(frozen=True)
class Stage:
    """``make`` takes the DataFrames it needs, in order, and its parameters by name, and gives a DataFrame."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)

    def code(self) -> str:
        return inspect.getsource(self.make)


@dataclass(frozen=True)
class Output:
    frame: DataFrame
    fingerprint: str
    reused: bool


def _ordered(stages: list[Stage], given: set[str]) -> list[Stage]:
    """Stages after what they need."""
    names = [s.name for s in stages]
    if len(set(names) | given) < len(names) + len(given):
        raise ValueError("a name is taken twice")
    done, left, out = set(given), list(stages), []
    while left:
        ready = [s for s in left if set(s.needs) <= done]
        if not ready:
            raise ValueError("; ".join(f"{s.name} lacks {sorted(set(s.needs) - done)}" for s in left))
        out += ready
        done |= {s.name for s in ready}
        left = [s for s in left if s.name not in done]
    return out


def run(spark: SparkSession, stages: list[Stage], sources: dict[str, DataFrame], root: str, marks: dict[str, str] | None = None) -> dict[str, Output]:
    """All stages' outputs by name. ``marks`` may tell sources' fingerprints that are known; the others are taken of their
    rows, in one pass each."""
    root = root.rstrip("/")
    known = {n: Output(df, (marks or {}).get(n) or G.fingerprint(df).first()["digest"], True) for n, df in sources.items()}
    found = dict(known)
    for stage in _ordered(stages, set(sources)):
        told = {"stage": stage.name, "code": stage.code(), "parameters": stage.parameters, "needs": [[n, found[n].fingerprint] for n in stage.needs]}
        mark = versions.fingerprint(told)
        marker = f"{root}/{stage.name}/{mark}.json"
        where, fs = versions._fs(spark, marker)
        reused = fs.exists(where)
        if not reused:
            path = f"{root}/{stage.name}/{mark}-{uuid.uuid4().hex}"
            stage.make(*(found[n].frame for n in stage.needs), **stage.parameters).write.parquet(path)
            versions.create(spark, marker, json.dumps({"path": path}))  # of two runs at once, the first one's output counts
        path = json.loads(spark.read.text(marker, wholetext=True).first()[0])["path"]
        found[stage.name] = Output(spark.read.parquet(path), mark, reused)
    return {s.name: found[s.name] for s in stages}


def evidence(outputs: dict[str, Output]) -> list[dict]:
    """What a report tells of a run: each stage's fingerprint, and whether it ran."""
    return [{"stage": n, "fingerprint": o.fingerprint, "reused": o.reused} for n, o in outputs.items()]
