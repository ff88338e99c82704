"""Aggregates, weighted metrics and calibration."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import aggregates as A
from tidemark.operators import ranks
from tidemark.plans.registry import plan


def r(x, n: int = 6):
    return F.round(x, n)


@plan("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 8) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def grouped_totals(t):
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), r(F.sum("l_extendedprice"), 2).alias("sum_base"), r(F.sum(paid), 2).alias("sum_disc"),
        r(F.avg("l_quantity")).alias("avg_qty"), r(F.avg("l_discount"), 8).alias("avg_disc"), F.count("*").alias("n"),
    )


_Q = ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS p{round(q * 100):02d}" for q in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99))


@plan(f"""SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 3) AS std,
round(skewness(l_extendedprice), 6) AS skew, {_Q} FROM lineitem""")
def dist_stats(t):
    d = A.distribution(t.lineitem, "l_extendedprice")
    digits = {"mean": 4, "std": 3, "skew": 6}
    return d.select("n", "min", "max", *(r(c, digits.get(c, 4)).alias(c) for c in d.columns if c not in ("n", "min", "max")))


@plan("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT count(*) FILTER (l_extendedprice < a - 1.0 * (b - a) OR l_extendedprice > b + 1.0 * (b - a)) AS outliers, count(*) AS n FROM lineitem, q""")
def iqr_outliers(t):
    return A.outliers(t.lineitem, "l_extendedprice", 1.0)


@plan("""SELECT p_type, count(DISTINCT p_brand) AS brands, round(median(p_retailprice), 4) AS median_price, min(p_name) AS first_name, min_by(p_partkey, p_retailprice * 1000000 + p_partkey) AS cheapest FROM part GROUP BY 1""")
def group_medians(t):
    found = t.part.groupBy("p_type").agg(
        F.countDistinct("p_brand").alias("brands"), F.min("p_name").alias("first_name"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"),
    )
    middle = ranks.quantiles(t.part, "p_retailprice", {"m": 0.5}, ["p_type"])
    return found.join(middle, "p_type", "left").select("p_type", "brands", r("m", 4).alias("median_price"), "first_name", "cheapest")


_PRED = """p AS (SELECT l.*, l_extendedprice AS y, l_quantity * p_retailprice * (1 + l_tax) AS p, 1.0 / count(*) OVER (PARTITION BY l_orderkey) AS w,
CASE WHEN l_quantity / 50 <= 0.3 THEN 'early' WHEN l_quantity / 50 <= 0.6 THEN 'mid' WHEN l_quantity / 50 <= 0.9 THEN 'late' ELSE 'very_late' END AS stage FROM lineitem l JOIN part ON l_partkey = p_partkey)"""
_MET = """round(sum(w * abs(y - p)) / sum(w), 3) AS mae, round(sqrt(sum(w * (y - p) * (y - p)) / sum(w)), 3) AS rmse,
round(1 - sum(w * (y - p) * (y - p)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)), 6) AS r2, round(100 * sum(CASE WHEN abs(y) >= 1 THEN w * abs((y - p) / y) END) / sum(CASE WHEN abs(y) >= 1 THEN w END), 4) AS mape, count(*) AS rows"""
_DIGITS = {"mae": 3, "rmse": 3, "r2": 6, "mape": 4, "rows": 0}
_STAGES = [label for _, label in X.STAGES]


def predicted(t):
    from tidemark.operators.windows import balanced_weight

    j = t.lineitem.withColumn("w", balanced_weight("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.withColumn("y", F.col("l_extendedprice")).withColumn("p", F.col("l_quantity") * F.col("p_retailprice") * (1 + F.col("l_tax"))).withColumn("stage", X.band(F.col("l_quantity") / 50, X.STAGES))


@plan(f"""WITH {_PRED} SELECT {_MET} FROM p""")
def weighted_regression_metrics(t):
    m = A.regression_metrics("y", "p", "w")
    return predicted(t).agg(*((r(x, _DIGITS[k]) if k != "rows" else x).alias(k) for k, x in m.items()))


@plan(f"""WITH {_PRED}, m AS (SELECT stage, {_MET} FROM p WHERE stage <> 'late' GROUP BY stage)
SELECT s.stage, mae, rmse, r2, mape, coalesce(rows, 0) AS rows, rows IS NOT NULL AS available FROM (VALUES ('early'), ('mid'), ('late'), ('very_late')) s(stage) LEFT JOIN m USING (stage)""")
def metrics_by_stage(t):
    rows = predicted(t).where("stage <> 'late'")
    out = A.by_level(rows, "stage", _STAGES, A.regression_metrics("y", "p", "w"))
    return out.select("stage", *((r(k, n) if k != "rows" else F.col(k)).alias(k) for k, n in _DIGITS.items()), "available")


@plan(f"""WITH {_PRED}, m AS (SELECT stage, {_MET} FROM p GROUP BY stage) SELECT round(avg(mae), 2) AS mae, round(avg(rmse), 2) AS rmse, count(*) AS levels FROM m""")
def stage_macro_average(t):
    levels = A.by_level(predicted(t), "stage", _STAGES, A.regression_metrics("y", "p", "w"))
    m = A.macro_average(levels, ["mae", "rmse"])
    return m.select(r("mae", 2).alias("mae"), r("rmse", 2).alias("rmse"), "levels")


_CLS = """c AS (SELECT CASE WHEN o_totalprice < 125000 THEN 'LOW' WHEN o_totalprice < 250000 THEN 'MEDIUM' WHEN o_totalprice < 375000 THEN 'HIGH' ELSE 'CRITICAL' END AS actual,
CASE WHEN c_acctbal < 1500 THEN 'LOW' WHEN c_acctbal < 4000 THEN 'MEDIUM' ELSE 'HIGH' END AS predicted FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS label), t AS (SELECT a.label AS actual, b.label AS predicted, count(c.actual) * 1.0::DOUBLE AS weight FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.label AND c.predicted = b.label GROUP BY 1, 2)"""
_LABELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def _classes(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    actual = F.when(F.col("o_totalprice") < 125000, "LOW").when(F.col("o_totalprice") < 250000, "MEDIUM").when(F.col("o_totalprice") < 375000, "HIGH").otherwise("CRITICAL")
    said = F.when(F.col("c_acctbal") < 1500, "LOW").when(F.col("c_acctbal") < 4000, "MEDIUM").otherwise("HIGH")
    return A.confusion(j.select(actual.alias("actual"), said.alias("predicted")), "actual", "predicted", _LABELS)


@plan(f"WITH {_CLS} SELECT * FROM t")
def risk_confusion(t):
    return _classes(t)


@plan(f"""WITH {_CLS}, a AS (SELECT actual AS label, sum(weight) AS is_, sum(CASE WHEN actual = predicted THEN weight ELSE 0 END) AS tp FROM t GROUP BY 1), b AS (SELECT predicted AS label, sum(weight) AS said FROM t GROUP BY 1),
m AS (SELECT tp, is_, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN is_ > 0 THEN tp / is_ ELSE 0 END AS r FROM a JOIN b USING (label))
SELECT round(sum(tp) / sum(is_), 8) AS accuracy, round(avg(p), 8) AS macro_precision, round(avg(r), 8) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 8) AS macro_f1 FROM m""")
def risk_metrics(t):
    m = A.classification_metrics(_classes(t), "actual", "predicted")
    return m.select(*(r(c, 8).alias(c) for c in m.columns))


@plan("""SELECT count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn
FROM (SELECT l_extendedprice > 60000 OR l_discount >= 0.09 AS a, l_quantity >= 40 AS p FROM lineitem)""")
def elevated_confusion(t):
    a, p = (F.col("l_extendedprice") > 60000) | (F.col("l_discount") >= 0.09), F.col("l_quantity") >= 40
    return t.lineitem.agg(A.count_where(a & p).alias("tp"), A.count_where(~a & p).alias("fp"), A.count_where(a & ~p).alias("fn"), A.count_where(~a & ~p).alias("tn"))


def _wq(q: float, by: str) -> str:
    return f"""SELECT {by}, CAST(min(x) FILTER (run >= {q} * total - 1e-12) AS DOUBLE) AS value FROM (SELECT {by}, x, sum(w) OVER (PARTITION BY {by} ORDER BY x ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY {by}) AS total
FROM (SELECT {by}, x, sum(w) AS w FROM e GROUP BY {by}, x)) GROUP BY {by}"""


_E = "e AS (SELECT l_returnflag, l_shipdate, CAST(l_extendedprice AS BIGINT) AS x, l_quantity AS w FROM lineitem)"


@plan(f"WITH {_E} {_wq(0.5, 'l_returnflag')}")
def weighted_median(t):
    e = t.lineitem.select("l_returnflag", F.bround("l_extendedprice", 0).cast("bigint").alias("x"), F.col("l_quantity").alias("w"))
    return A.weighted_quantile(e, "x", "w", 0.5, ["l_returnflag"])


@plan(f"WITH {_E} {_wq(0.9, 'l_returnflag')}")
def weighted_quantile(t):
    e = t.lineitem.select("l_returnflag", F.bround("l_extendedprice", 0).cast("bigint").alias("x"), F.col("l_quantity").alias("w"))
    return A.weighted_quantile(e, "x", "w", 0.9, ["l_returnflag"])


_CAL = """e AS (SELECT l_returnflag AS stage, l_extendedprice AS x, CAST(l_partkey % 1000 AS DOUBLE) - 500 AS res, l_quantity AS w FROM lineitem),
q AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS f), ed AS (SELECT list_sort(list_distinct(list(v))) AS edges FROM (SELECT quantile_cont(x, 0.2) AS v FROM e UNION ALL SELECT quantile_cont(x, 0.4) FROM e UNION ALL SELECT quantile_cont(x, 0.6) FROM e UNION ALL SELECT quantile_cont(x, 0.8) FROM e)),
b AS (SELECT e.*, CAST(len(list_filter(edges, lambda z: x >= z)) AS INTEGER) AS bin FROM e, ed)"""


def _median_sql(by: str, name: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"""{name} AS (SELECT {cols}min(res) FILTER (run >= 0.5 * total - 1e-12) AS v, max(total) AS weight, sum(n) AS n FROM (SELECT {cols}res, n, sum(w) OVER ({part}ORDER BY res ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER ({part}) AS total
FROM (SELECT {cols}res, sum(w) AS w, count(*) AS n FROM b GROUP BY {cols}res)) {'GROUP BY ' + by if by else ''})"""


def _residuals(t):
    return t.lineitem.select(F.col("l_returnflag").alias("stage"), F.col("l_extendedprice").alias("x"), (F.pmod("l_partkey", F.lit(1000)).cast("double") - 500).alias("res"), F.col("l_quantity").alias("w"))


@plan(f"""WITH {_CAL}, {_median_sql('stage, bin', 'f')}, {_median_sql('bin', 'c')}, {_median_sql('', 'o')}
SELECT stage, bin, coalesce(CASE WHEN f.n >= 20 THEN f.v END, c.v, o.v) AS correction, count(*) AS n FROM b LEFT JOIN f USING (stage, bin) LEFT JOIN c USING (bin) CROSS JOIN o GROUP BY ALL""")
def residual_calibration(t):
    return A.calibrated(_residuals(t), "x", "res", "stage", "w").groupBy("stage", "bin", "correction").agg(F.count("*").alias("n"))


@plan(f"""WITH {_CAL}, {_median_sql('stage, bin', 'f')}, {_median_sql('bin', 'c')}, {_median_sql('', 'o')}, cc AS (SELECT bin, c.weight / (c.weight + 40) * c.v + (1 - c.weight / (c.weight + 40)) * o.v AS v FROM c, o)
SELECT stage, f.bin, round(f.weight / (f.weight + 40) * f.v + (1 - f.weight / (f.weight + 40)) * cc.v, 6) AS correction FROM f JOIN cc USING (bin)""")
def shrunk_calibration(t):
    out = A.shrunk_calibration(_residuals(t), "x", "res", "stage", "w")
    return out.select("stage", "bin", r("correction").alias("correction"))


@plan("""SELECT o_orderpriority, round((sum(o_totalprice) + 5 * any_value(g)) / (count(*) + 5), 4) AS value, count(*) AS support FROM orders, (SELECT avg(o_totalprice) AS g FROM orders) GROUP BY 1""")
def smoothed_means(t):
    from tidemark.operators.joins import smoothed_means as smooth

    return smooth(t.orders, "o_totalprice", ["o_orderpriority"], 5.0).select("o_orderpriority", r("value", 4).alias("value"), "support")


@plan("""WITH q AS (SELECT quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS r FROM events)
SELECT event_id, round(greatest(0.25, least(1.0, 1 / (1 + abs(value - m) / greatest(r, 1e-9)))), 6) AS weight FROM events, q""")
def robust_weights(t):
    return A.robust_weight(t.events, "value").select("event_id", r("weight").alias("weight"))


@plan("""WITH c AS (SELECT s, avg(CAST(value BETWEEN 50 - 20 * s AND 50 + 20 * s AS INTEGER)) * 100 AS cov FROM events, (SELECT unnest([1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0]) AS s) GROUP BY s)
SELECT CAST(coalesce(min(s) FILTER (cov >= 78), 4.0) AS DOUBLE) AS factor FROM c""")
def widening_factor(t):
    e = t.events.select(F.col("value").alias("y"), F.lit(30.0).alias("low"), F.lit(50.0).alias("mid"), F.lit(70.0).alias("high"))
    return A.widening_factor(e, "y", "low", "mid", "high")


@plan("""SELECT c_mktsegment, round(avg(CAST(c_acctbal BETWEEN 0 AND 5000 AS INTEGER)) * 100, 6) AS coverage FROM customer GROUP BY 1""")
def interval_coverage(t):
    return t.customer.groupBy("c_mktsegment").agg(r(A.interval_coverage("c_acctbal", F.lit(0.0), F.lit(5000.0))).alias("coverage"))


@plan("""SELECT min_by(p_brand, a * 1000 + CAST(substring(p_brand, 7) AS INTEGER) / 1000.0) AS p_brand, round(min(a), 4) AS score FROM (SELECT p_brand, avg(p_retailprice) AS a FROM part GROUP BY 1)""")
def argmin_selection(t):
    m = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("score")).withColumn("place", F.substring("p_brand", 7, 9).try_cast("int"))
    return A.best(m, "p_brand", "score", "place").select("p_brand", r("score", 4).alias("score"))


@plan("""SELECT CASE WHEN e < 5 THEN '[0,5)' WHEN e < 15 THEN '[5,15)' WHEN e < 30 THEN '[15,30)' ELSE '[30,inf)' END AS bucket, count(*) AS n FROM (SELECT abs(value - 50) AS e FROM events) GROUP BY 1""")
def error_buckets(t):
    e = F.abs(F.col("value") - 50)
    bucket = X.band(e, ((5, "[0,5)"), (15, "[5,15)"), (30, "[15,30)"), (None, "[30,inf)")), "left")
    return t.events.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@plan("""SELECT fold, round(avg(v), 4) AS mean, round(min(v), 4) AS low, round(max(v), 4) AS high FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS fold, o_totalprice AS v FROM orders) GROUP BY 1""")
def fold_summary(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("fold")).agg(r(F.avg("o_totalprice"), 4).alias("mean"), r(F.min("o_totalprice"), 4).alias("low"), r(F.max("o_totalprice"), 4).alias("high"))


def _times_sql() -> str:
    """Poisson(1) counts, as sums of what lies above the distribution function."""
    cuts = [sum(1 / math.factorial(k) for k in range(n + 1)) / math.e for n in range(8)]
    return " + ".join(f"CAST(u > {x!r}::DOUBLE AS INTEGER)" for x in cuts)


@plan(f"""WITH {_PRED}, e AS (SELECT l_orderkey AS k, avg(abs(y - p)) AS b, avg(abs(y - 0.98 * p)) AS n FROM p GROUP BY 1),
d AS (SELECT b, n, draw, (CAST('0x' || substring(md5('7|' || k || '|' || draw), 1, 10) AS BIGINT) + 0.5) / 1099511627776.0::DOUBLE AS u FROM e, range(1, 201) r(draw)),
g AS (SELECT draw, 100 * (sum(({_times_sql()}) * b) - sum(({_times_sql()}) * n)) / sum(({_times_sql()}) * b) AS gain FROM d GROUP BY 1)
SELECT round(avg(gain), 6) AS mean_gain, round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.975), 6) AS high, avg(CAST(gain > 0 AS INTEGER)) AS p_better, count(*) AS draws FROM g""")
def bootstrap_ci(t):
    """Entities are orders; errors of two predictions of a line's price. The draws come from hashes, so the result is the
    same on every run."""
    e = predicted(t).select("l_orderkey", F.abs(F.col("y") - F.col("p")).alias("a"), F.abs(F.col("y") - 0.98 * F.col("p")).alias("b"))
    return A.paired_bootstrap(e, "l_orderkey", "a", "b", draws=200).select(*(r(c).alias(c) for c in ("mean_gain", "low", "high")), "p_better", "draws")
