"""Proportional hazards over tables of any length: partial likelihood by running sums over ranges of time.

Rows are summed to distinct durations first. What is at risk at a duration is the sum over that and all longer ones, which
comes from ``ranks.before`` over descending durations: no task sorts or holds the table. Each Newton step brings one row of
d + d (d + 1) / 2 sums to the driver, for d covariates.

Ties are Efron's. Covariates are standardised for the fit, and the ridge is n * ridge / 2 times the squared standardised
coefficients, so that it weighs the same for any number of rows. Rows without a positive duration, or with a missing event,
are left out; missing covariates are filled by their medians (0 if a column has none).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.ml.stages import TableModel, _numbers, _text, _texts
from tidemark.operators import ranks
from tidemark.operators.tables import stored


#: Tied events that are summed one by one; of more, these are the last ones, and a series sums the others.
CHUNK = 200


def _filled(df: DataFrame, covariates: list[str]) -> tuple[DataFrame, list[float]]:
    medians = [ranks.quantiles(df.select(F.col(c).cast("double").alias(c)), c, {"m": 0.5}).first() for c in covariates]
    fill = [float(m["m"]) if m and m["m"] is not None else 0.0 for m in medians]
    return df, fill


def _z(covariates: list[str], fill: list[float], means: list[float], sds: list[float]) -> list[Column]:
    return [(F.coalesce(F.col(c).cast("double"), F.lit(f)) - m) / s for c, f, m, s in zip(covariates, fill, means, sds, strict=True)]


def _efron(placed: DataFrame) -> DataFrame:
    """placed with sums over l from 0 to n - 1, where 1 - l f is what is left of a risk set after l of n tied events: ``a1`` of
    1 / (1 - l f), ``a2`` of its square, ``logs`` of ln(1 - l f). No row's work grows with n: the last CHUNK terms are summed
    one by one, those before by Euler and Maclaurin's formula, which far from the last term is as exact as a sum."""
    m = F.greatest(F.col("n") - CHUNK, F.lit(0)).cast("double")
    tail = lambda x: F.expr(f"aggregate(sequence(0L, least(n, {CHUNK}L) - 1), 0.0D, (s, l) -> s + {x.replace('left', '(1 - (_m + l) * f)')})")
    placed = placed.withColumn("_m", m).withColumns({"_v": 1 - F.col("_m") * F.col("f"), "_log": F.log1p(-F.col("_m") * F.col("f"))})
    body = lambda x, still: F.when(F.col("f") > 0, F.expr(x)).otherwise(F.col("_m") * still)
    a1 = "-_log / f + (1 - 1 / _v) / 2 + f / 12 * (pow(_v, -2) - 1) - pow(f, 3) / 120 * (pow(_v, -4) - 1) + pow(f, 5) / 252 * (pow(_v, -6) - 1)"
    a2 = "_m / _v + (1 - pow(_v, -2)) / 2 + f / 6 * (pow(_v, -3) - 1) - pow(f, 3) / 30 * (pow(_v, -5) - 1) + pow(f, 5) / 42 * (pow(_v, -7) - 1)"
    logs = "-_v * _log / f - _m - _log / 2 - f / 12 * (1 / _v - 1) + pow(f, 3) / 360 * (pow(_v, -3) - 1) - pow(f, 5) / 1260 * (pow(_v, -5) - 1)"
    return placed.withColumns({
        "a1": body(a1, 1) + tail("1 / left"), "a2": body(a2, 1) + tail("1 / (left * left)"), "logs": body(logs, 0) + tail("ln(left)"),
    }).drop("_m", "_v", "_log")


def _likelihood(rows: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, gradient and Hessian at beta; rows have t, event and z0, z1, ..."""
    d = len(beta)
    eta = sum((F.col(f"z{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    e = F.exp(F.col("_eta"))
    event = F.col("event")
    rows = rows.withColumn("_eta", eta)
    at_risk = {"r": e} | {f"r{i}": e * F.col(f"z{i}") for i in range(d)} | {f"r{i}_{j}": e * F.col(f"z{i}") * F.col(f"z{j}") for i, j in pairs}
    ended = {f"d{k[1:]}": F.when(event, x) for k, x in at_risk.items()}
    own = {"n": F.when(event, 1).otherwise(0), "l": F.when(event, F.col("_eta"))} | {f"x{i}": F.when(event, F.col(f"z{i}")) for i in range(d)}
    sums = {k: F.coalesce(F.sum(x), F.lit(0.0 if k != "n" else 0)).alias(k) for k, x in (at_risk | ended | own).items()}
    times = rows.groupBy((-F.col("t")).alias("later")).agg(*sums.values())
    placed = ranks.before(times, "later", list(at_risk)).where("n > 0")
    risk = lambda k: F.col(k) + F.col(f"_before_{k}")
    # Means over what is at risk and over what ends. Stored (a row a duration), as is the next step: in one plan, each
    # expression would hold those before it many times over.
    part = F.col("d") / F.col("n")
    placed = placed.select("n", "l", *(f"x{i}" for i in range(d)), risk("r").alias("r"), (part / risk("r")).alias("f"), *(
        x for k in list(at_risk)[1:] for x in ((risk(k) / risk("r")).alias(k), F.coalesce(F.try_divide(f"d{k[1:]}", "d"), F.lit(0.0)).alias(f"d{k[1:]}"))
    ))
    placed = stored(_efron(stored(placed, "cox-risk")), "cox-ties")
    r, e_ = (lambda i: F.col(f"r{i}")), (lambda i: F.col(f"d{i}"))
    g = [F.sum(F.col(f"x{i}") - F.col("a1") * r(i) + (F.col("a1") - F.col("n")) * e_(i)) for i in range(d)]
    h = [
        F.sum(
            F.col("a1") * F.col(f"r{i}_{j}") - (F.col("a1") - F.col("n")) * F.col(f"d{i}_{j}")
            - F.col("a2") * r(i) * r(j) + (F.col("a2") - F.col("a1")) * (r(i) * e_(j) + e_(i) * r(j)) - (F.col("a2") - 2 * F.col("a1") + F.col("n")) * e_(i) * e_(j)
        )
        for i, j in pairs
    ]
    found = [x or 0.0 for x in placed.agg(F.sum(F.col("l") - F.col("n") * F.ln("r") - F.col("logs")), *g, *h).first()]
    hessian = np.zeros((d, d))
    for (i, j), x in zip(pairs, found[1 + d :], strict=True):
        hessian[i, j] = hessian[j, i] = -x
    return float(found[0]), np.array(found[1 : 1 + d], float), hessian


def fit(df: DataFrame, covariates: list[str], duration: str, event: str | None = None, ridge: float = 0.2, steps: int = 30, tolerance: float = 1e-9) -> CoxModel:
    """event: a boolean or 0/1 column, true where the end was seen; without one, all ends were."""
    ended = F.lit(True) if event is None else F.col(event).cast("boolean")
    known = df.where((F.col(duration) > 0) & ended.isNotNull())
    known = stored(known.select(*(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(covariates)), F.col(duration).cast("double").alias("t"), ended.alias("event")), "cox-known")
    names, covariates, ended = list(covariates), [f"_c{i}" for i in range(len(covariates))], F.col("event")
    known, fill = _filled(known, covariates)
    plain = _z(covariates, fill, [0.0] * len(covariates), [1.0] * len(covariates))
    shape = known.agg(F.count("*"), F.count_if(ended), *(f(x) for x in plain for f in (F.avg, F.stddev_pop))).first()
    n, events, rest = shape[0], shape[1], list(shape[2:])
    if not events:
        raise ValueError("no end was seen")
    means, sds = [float(x) for x in rest[::2]], [float(x) if x else 1.0 for x in rest[1::2]]
    z = _z(covariates, fill, means, sds)
    rows = stored(known.select("t", "event", *(x.alias(f"z{i}") for i, x in enumerate(z))), "cox-rows")
    d = len(covariates)
    beta, taken = np.zeros(d), 0
    penalised = lambda found, b: found[0] - n * ridge / 2 * float(b @ b)
    found = _likelihood(rows, beta)
    for taken in range(1, steps + 1):
        gradient, hessian = found[1] - n * ridge * beta, found[2] - n * ridge * np.eye(d)
        step = np.linalg.solve(hessian - 1e-12 * np.eye(d), gradient)
        size = 1.0
        while True:  # halve steps that make it worse
            new = beta - size * step
            next_found = _likelihood(rows, new)
            if penalised(next_found, new) >= penalised(found, beta) - 1e-9 * abs(penalised(found, beta)) or size < 1e-3:
                break
            size /= 2
        moved, beta, found = float(np.max(np.abs(new - beta), initial=0.0)), new, next_found
        if moved < tolerance:
            break
    # Breslow's baseline: events over what was at risk, summed up to each duration with events.
    eta = sum((F.col(f"z{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
    times = rows.groupBy((-F.col("t")).alias("later")).agg(F.sum(F.exp(eta)).alias("r"), F.count_if("event").alias("n"))
    risk = ranks.before(times, "later", ["r"]).where("n > 0")
    hazard = risk.select((-F.col("later")).alias("t"), (F.col("n") / (F.col("r") + F.col("_before_r"))).alias("h"))
    base = ranks.before(hazard, "t", ["h"]).select("t", (F.col("h") + F.col("_before_h")).alias("hazard"))
    model = CoxModel({"baseline": stored(base, "cox-baseline")})
    model._set(
        covariates=names, fill=fill, means=means, sds=sds, standardised=[float(b) for b in beta], duration=duration,
        fitted=[float(n), float(events), float(found[0]), float(taken)],
    )
    return model


class CoxModel(TableModel):
    """Coefficients and the cumulative baseline hazard at mean covariates. ``transform`` adds the log hazard ratio against
    them; ``finished_within`` gives probabilities."""

    covariates = _texts("covariates", "columns")
    fill = _numbers("fill", "what stands for a missing value")
    means = _numbers("means", "means of the fit's rows")
    sds = _numbers("sds", "standard deviations of the fit's rows")
    standardised = _numbers("standardised", "coefficients of standardised covariates")
    duration = _text("duration", "the column of durations that was fitted")
    fitted = _numbers("fitted", "rows, events, log partial likelihood, Newton steps")

    @property
    def coefficients(self) -> dict[str, float]:
        """By covariate, a unit of it."""
        return {c: b / s for c, b, s in zip(self.getOrDefault("covariates"), self.getOrDefault("standardised"), self.getOrDefault("sds"), strict=True)}

    def _ratio(self) -> Column:
        z = _z(self.getOrDefault("covariates"), self.getOrDefault("fill"), self.getOrDefault("means"), self.getOrDefault("sds"))
        return sum((x * b for x, b in zip(z, self.getOrDefault("standardised"), strict=True)), F.lit(0.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("log_hazard_ratio", self._ratio())

    def hazard_at(self, times: list[float]) -> list[float]:
        """The cumulative baseline hazard at each of a few times, from one pass over the baseline."""
        at = [F.coalesce(F.max(F.when(F.col("t") <= float(x), F.col("hazard"))), F.lit(0.0)) for x in times]
        return list(self.tables["baseline"].agg(*at).first()) if times else []

    def finished_within(self, dataset: DataFrame, times: dict[str, float]) -> DataFrame:
        """dataset with the probability that the end comes within each of the named times: 1 - exp(-H(t) exp(ratio))."""
        hazards = self.hazard_at(list(times.values()))
        return dataset.withColumns({name: 1 - F.exp(-F.lit(float(h)) * F.exp(self._ratio())) for name, h in zip(times, hazards, strict=True)})


#: Rows of which one task counts the pairs among themselves.
TASK_ROWS = 250_000


def _crossings(rows: DataFrame) -> int:
    """rows has x, y (doubles) and n, and x and y together only once. How many pairs, n times n of them, have the lesser x with the
    greater y.

    In order of x and then y these are the pairs with the greater y first. Each range of that order counts those within it. For
    a pair of two ranges their numbers stand for x, so what is left is the same question about y and the numbers, of as many rows
    as a range has values of y; it is asked again until one range has all. No task holds more than a range, whatever is tied.
    """

    def count(batches):
        """A task's rows x, y, n, p, in any order: how many of its pairs have the lesser x with the greater y, as ``pairs``, and a row
        for each y, with p."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        x, y, n, p = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(4))
        order = np.lexsort((y, x))
        values, rank = np.unique(y[order], return_inverse=True)
        n = n[order]
        sums = np.bincount(rank, weights=n).astype(np.int64)
        pairs = 0
        # From the highest bit down: of two ranks that agree in the higher bits, the one with the bit set is the greater.
        for bit in reversed(range(int(rank.max()).bit_length())):
            part = rank >> (bit + 1)
            high = (rank >> bit) & 1 == 1
            above = np.where(high, n, 0)
            ahead = np.cumsum(above)
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ahead -= np.repeat((ahead - above)[starts], np.diff(np.append(starts, len(part))))
            pairs += int((n * ahead)[~high].sum())
            key = rank >> bit
            order = np.argsort(key.astype(np.min_scalar_type(int(key.max()))), kind="stable")
            rank, n = rank[order], n[order]
        none = pa.nulls(len(values), pa.int64())
        yield pa.RecordBatch.from_pydict({"x": values, "y": np.full(len(values), float(p[0])), "n": sums, "pairs": none})
        yield pa.RecordBatch.from_pydict({"x": [0.0], "y": [0.0], "n": [0], "pairs": [pairs]})

    total, size = 0, None
    while True:
        n = rows.count()
        size = size or max(TASK_ROWS, 2 * math.isqrt(n))
        tasks = max(1, -(-n // size))
        ranged = rows.repartitionByRange(tasks, "x", "y").select("x", "y", "n", F.spark_partition_id().alias("p"))
        found = stored(ranged.mapInArrow(count, "x double, y double, n long, pairs long"), "pairs")
        total += found.agg(F.sum("pairs")).first()[0] or 0
        if tasks == 1:
            return total
        rows = found.where("pairs IS NULL").drop("pairs")


def _all_pairs(df: DataFrame, risk: str, duration: str) -> DataFrame:
    known = df.where(F.col(risk).isNotNull() & F.col(duration).isNotNull())
    rows = stored(known.groupBy(F.col(risk).cast("double").alias("x"), F.col(duration).cast("double").alias("y")).agg(F.count("*").alias("n")), "pairs")
    twice = F.col("n").cast("decimal(19,0)") * (F.col("n") - 1)  # pairs within what is tied, each counted twice
    tied = lambda *by: int(rows.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.sum(twice)).first()[0] or 0) // 2
    right = _crossings(rows)
    pairs = tied() - tied("x") - tied("y") + tied("x", "y")
    share = F.lit(right / pairs if pairs else None).cast("double")
    return df.sparkSession.range(1).select(share.alias("concordance"), F.lit(pairs).cast("long").alias("pairs"))


def concordance(df: DataFrame, risk: str, duration: str, buckets: int | None = 16) -> DataFrame:
    """One row: of the pairs of rows that differ in duration and in the bucket of their risk (all ends seen), the share in
    which the riskier row ends first, and how many pairs there are. Risks are cut into buckets by quantiles, so that pairs
    are counted from running sums over durations, not made. With None for buckets, of all pairs that differ in duration and
    in risk: none is left out, and none is made either."""
    if buckets is None:
        return _all_pairs(df, risk, duration)
    cuts = ranks.quantiles(df, risk, {f"q{i}": i / buckets for i in range(1, buckets)}).first()
    edges = sorted({x for x in (cuts or []) if x is not None})
    bucket = sum((F.when(F.col(risk) > e, 1).otherwise(0) for e in edges), F.lit(0))
    counted = df.where(F.col(risk).isNotNull() & F.col(duration).isNotNull()).withColumn("_bucket", bucket)
    n = len(edges) + 1
    # Counts of the buckets beyond each: sums of sums in one plan would nest as deep as there are buckets.
    counts = [F.count("*").alias("all"), *(f.alias(f"{k}{i}") for i in range(n) for k, f in (("c", F.count_if(F.col("_bucket") == i)), ("a", F.count_if(F.col("_bucket") > i))))]
    placed = ranks.before(counted.groupBy(F.col(duration).alias("t")).agg(*counts), "t", ["all", *(f"a{i}" for i in range(n))])
    right = [F.sum(F.col(f"c{i}") * F.col(f"_before_a{i}")).alias(f"right{i}") for i in range(n)]
    wrong = [F.sum(F.col(f"c{i}") * (F.col("_before_all") - F.col(f"_before_a{i - 1}"))).alias(f"wrong{i}") for i in range(1, n)]
    total = stored(placed.agg(*right, *wrong), "pairs")
    total = total.select(sum((F.col(f"right{i}") for i in range(n)), F.lit(0)).alias("right"), sum((F.col(f"wrong{i}") for i in range(1, n)), F.lit(0)).alias("wrong"))
    return total.select((F.col("right") / (F.col("right") + F.col("wrong"))).alias("concordance"), (F.col("right") + F.col("wrong")).alias("pairs"))
