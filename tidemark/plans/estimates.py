"""Cross-fitting, residual boosters, proportional hazards, quantile bands, explanations and priors on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.ml import cox, crossfit, explain, pinball
from tidemark.ml import models as M
from tidemark.ml.stages import HierarchicalPrior
from tidemark.operators import windows as W
from tidemark.operators.tables import stored
from tidemark.plans.registry import plan


def r(x, n: int = 6):
    return F.round(x, n)


def _prices(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), "l_returnflag",
        F.col("l_extendedprice").alias("y"), F.year("l_shipdate").alias("yr"),
    ).withColumn("w", W.balanced_weight("l_orderkey"))


_FEATURES = M.Features(("l_quantity", "l_discount", "l_tax"), ("l_returnflag",))

_FOLDS = """p AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS y, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS w,
CAST(('0x' || substring(md5('7|' || l_orderkey), 1, 8)) AS BIGINT) % 5 AS fold FROM lineitem),
c AS (SELECT l_returnflag, fold, sum(w * y) AS s, sum(w) AS n FROM p GROUP BY 1, 2),
m AS (SELECT a.l_returnflag, a.fold, sum(b.s) / sum(b.n) AS mean FROM c a JOIN c b ON a.l_returnflag = b.l_returnflag AND a.fold <> b.fold GROUP BY 1, 2)"""


@plan(f"""WITH {_FOLDS} SELECT l_returnflag, CAST(fold AS INTEGER) AS fold, count(*) AS rows, count(DISTINCT l_orderkey) AS entities, round(any_value(mean), 4) AS mean,
round(sum(w * abs(y - mean)) / sum(w), 4) AS mae FROM p JOIN m USING (l_returnflag, fold) GROUP BY 1, 2""")
def out_of_fold_means(t):
    """Each line's price predicted by its group's mean over other folds' orders."""
    found = crossfit.out_of_fold_means(_prices(t), ["l_returnflag"], "l_orderkey", "y", "w")
    mae = F.sum(F.col("w") * F.abs(F.col("y") - F.col("prediction"))) / F.sum("w")
    return found.groupBy("l_returnflag", "fold").agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("entities"), r(F.max("prediction"), 4).alias("mean"), r(mae, 4).alias("mae"))


@plan(f"""WITH {_FOLDS}, e AS (SELECT abs(y - mean) AS e, sum(w) AS w FROM p JOIN m USING (l_returnflag, fold) GROUP BY 1),
k AS (SELECT e, sum(w) OVER (ORDER BY e) AS run, sum(w) OVER () AS total FROM e) SELECT round(min(e), 4) AS cap FROM k WHERE run >= 0.9 * total - 1e-12""")
def residual_cap(t):
    """The bound of a booster's corrections: the weighted 0.9 quantile of what out-of-fold predictions leave."""
    found = crossfit.out_of_fold_means(_prices(t), ["l_returnflag"], "l_orderkey", "y", "w")
    return crossfit.cap(found.withColumn("residual", F.col("y") - F.col("prediction")), "residual", "w").select(r("cap", 4).alias("cap"))


@plan()
def residual_booster(t):
    """A booster on out-of-fold residuals, bounded, on the last year; trained on years before, folds by year."""
    rows = stored(_prices(t), "prices")
    found = crossfit.booster_gain(rows, _FEATURES, "y", "w", "yr", "l_orderkey", M.families("y", "w")["linear"], least=0.0)
    return found.select(r("cap", 2).alias("cap"), "rows", r("mae", 2).alias("mae"), r("boosted_mae", 2).alias("boosted_mae"), (F.col("largest_correction") <= F.col("cap") + 1e-6).alias("bounded"), "better")


@plan("""WITH RECURSIVE x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS z, CAST(l_quantity AS DOUBLE) AS t, l_linestatus = 'F' AS e FROM lineitem),
n AS (SELECT count(*) AS n, avg(z) AS m, stddev_pop(z) AS sd FROM x WHERE t > 0),
g AS (SELECT t, count(*) FILTER (z = 0) AS c0, count(*) FILTER (z = 1) AS c1, count(*) FILTER (e AND z = 0) AS d0, count(*) FILTER (e AND z = 1) AS d1 FROM x WHERE t > 0 GROUP BY 1),
k AS (SELECT t, d0, d1, sum(c0) OVER w AS r0, sum(c1) OVER w AS r1 FROM g WINDOW w AS (ORDER BY t DESC)),
l AS (SELECT *, (0 - m) / sd AS a, (1 - m) / sd AS b, unnest(range(0, d0 + d1)) / (d0 + d1)::DOUBLE AS f FROM k, n),
s(i, beta) AS (SELECT 0, 0.0::DOUBLE UNION ALL
  SELECT i + 1, any_value(beta) - (sum(-q1 / q0) + any_value(obs) - any_value(n.n) * 0.2 * any_value(beta)) / (-sum(q2 / q0 - (q1 / q0) * (q1 / q0)) - any_value(n.n) * 0.2)
  FROM (SELECT i, beta, (r0 - f * d0) * exp(beta * a) + (r1 - f * d1) * exp(beta * b) AS q0, a * (r0 - f * d0) * exp(beta * a) + b * (r1 - f * d1) * exp(beta * b) AS q1,
               a * a * (r0 - f * d0) * exp(beta * a) + b * b * (r1 - f * d1) * exp(beta * b) AS q2 FROM s, l WHERE i < 12),
       (SELECT sum(d0 * (0 - m) / sd + d1 * (1 - m) / sd) AS obs FROM k, n), n GROUP BY i)
SELECT t AS duration, d0 + d1 AS ended, round(sum((d0 + d1) / (r0 * exp(beta * (0 - m) / sd) + r1 * exp(beta * (1 - m) / sd))) OVER (ORDER BY t), 6) AS hazard, round(beta / sd, 6) AS coefficient
FROM k, n, (SELECT beta FROM s WHERE i = 12) WHERE d0 + d1 > 0""")
def hazard_of_returns(t):
    """Proportional hazards of the quantity at which a line is filled, by whether it was returned: the cumulative hazard."""
    rows = t.lineitem.select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("returned"), F.col("l_quantity").cast("double").alias("duration"), (F.col("l_linestatus") == "F").alias("filled"))
    model = cox.fit(rows, ["returned"], "duration", "filled")
    ended = rows.where(F.col("filled") & (F.col("duration") > 0)).groupBy("duration").agg(F.count("*").alias("ended"))
    hazard = model.tables["baseline"].select(F.col("t").alias("duration"), r("hazard").alias("hazard"))
    return ended.join(hazard, "duration").select("duration", "ended", "hazard", r(F.lit(model.coefficients["returned"])).alias("coefficient"))


@plan()
def hazard_ratios(t):
    """Days from order to shipment by several covariates: coefficients, and how well the ratios order the durations, over
    all pairs."""
    both = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = both.select(F.datediff("l_shipdate", "o_orderdate").cast("double").alias("days"), "l_quantity", "l_discount", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), F.log1p("l_extendedprice").alias("size"))
    rows = stored(rows, "shipped")
    names = ["l_quantity", "l_discount", "l_tax", "size"]
    model = cox.fit(rows, names, "days")
    found = cox.concordance(model.transform(rows.where("days > 0")), "log_hazard_ratio", "days", buckets=None)
    table = F.inline(F.array(*(F.struct(F.lit(c).alias("covariate"), r(F.lit(b)).alias("coefficient")) for c, b in model.coefficients.items())))
    return found.select(r("concordance", 4).alias("concordance"), table)


@plan()
def quantile_bands(t):
    """Lines of p10, p50 and p90, widened by what the last year tells, over all rows by year."""
    rows = stored(_prices(t).where("yr IS NOT NULL"), "prices")
    lines, told = pinball.calibrated_bands(rows, _FEATURES, "y", "w", "yr")
    held = pinball.bands(lines.predict(rows, {0.1: "p10", 0.5: "p50", 0.9: "p90"}), "p10", "p50", "p90")
    wide = pinball.widened(held, told["factor"], "p10", "p50", "p90")
    inside = F.avg(F.col("y").between(F.col("p10"), F.col("p90")).cast("double")) * 100
    return wide.groupBy("yr").agg(F.count("*").alias("rows"), r(inside, 1).alias("coverage"), r(F.avg(F.col("p90") - F.col("p10")), 0).alias("width"), F.lit(told["factor"]).alias("factor"))


@plan()
def absolute_loss_trees(t):
    """Median trees and lines beside least squares, on the last year."""
    rows = stored(_prices(t).where("yr IS NOT NULL"), "prices")
    last = rows.agg(F.max("yr")).first()[0]
    early, late = rows.where(F.col("yr") < last), rows.where(F.col("yr") == last)
    trees = pinball.quantile_trees(early, _FEATURES, "y", "w", 0.5, rounds=4, depth=3, step=0.5)
    lines = pinball.quantile_lines(early, _FEATURES, "y", "w", (0.5,))
    plain = M.fit(early, _FEATURES, M.families("y", "w")["linear"])
    held = lines.predict(trees.predict(late, "trees"), {0.5: "lines"})
    held = M.predict(plain, held, _FEATURES, "squares")
    mae = lambda p: F.sum(F.col("w") * F.abs(F.col("y") - F.col(p))) / F.sum("w")
    found = held.agg(*(mae(p).alias(p) for p in ("trees", "lines", "squares")), F.count("*").alias("rows"))
    return found.select("rows", F.inline(F.array(*(F.struct(F.lit(p).alias("loss"), r(p, 1).alias("mae")) for p in ("trees", "lines", "squares")))))


@plan()
def price_explanations(t):
    """The three features that move each line's predicted price most, for a forest; parts and rest sum to the prediction less
    the base."""
    rows = stored(_prices(t), "prices")
    model = M.fit(rows, _FEATURES, M.RandomForestRegressor(featuresCol="features", labelCol="y", weightCol="w", numTrees=8, maxDepth=4, seed=7))
    read = rows.select("l_orderkey", "l_linenumber", *_FEATURES.numeric, *_FEATURES.categorical)  # what goes through Python
    parts, base, names = explain.explained(model, read, _FEATURES)
    top = explain.top_factors(parts, names, 3)
    told = F.lit(base) + sum((F.col("factors")[i]["impact"] for i in range(3)), F.lit(0.0)) + F.col("rest")
    factor = lambda i: F.col("factors")[i]["feature"].alias(f"factor_{i + 1}")
    return top.select("l_orderkey", "l_linenumber", r("prediction", 2).alias("prediction"), factor(0), factor(1), factor(2), r(F.col("factors")[0]["impact"], 2).alias("impact"), (F.abs(told - F.col("prediction")) < 1e-6).alias("exact"))


@plan("WITH o AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, CAST(year(o_orderdate) AS INTEGER) AS yr, o_totalprice AS v FROM orders)"
      ", a AS (SELECT y.p, y.s, y.yr, sum(o.v) / count(*) AS mean, count(*) AS n FROM (SELECT DISTINCT p, s, yr FROM o) y JOIN o ON o.p = y.p AND o.s = y.s AND o.yr < y.yr GROUP BY ALL)"
      ", b AS (SELECT y.s, y.yr, sum(o.v) / count(*) AS mean, count(*) AS n FROM (SELECT DISTINCT s, yr FROM o) y JOIN o ON o.s = y.s AND o.yr < y.yr GROUP BY ALL)"
      ", c AS (SELECT y.yr, sum(o.v) / count(*) AS mean FROM (SELECT DISTINCT yr FROM o) y JOIN o ON o.yr < y.yr GROUP BY ALL)"
      " SELECT o.o_orderkey, round(coalesce((a.n * a.mean + 20 * c.mean) / (a.n + 20), (b.n * b.mean + 20 * c.mean) / (b.n + 20), c.mean, 0), 4) AS prior, CAST(coalesce(a.n, b.n, 0) AS BIGINT) AS prior_support"
      " FROM o LEFT JOIN a USING (p, s, yr) LEFT JOIN b USING (s, yr) LEFT JOIN c USING (yr)")  # fmt: skip
def priors_of_earlier_years(t):
    """What orders of a priority and status, or of a status, cost in strictly earlier years, for the rows of a fit."""
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("yr"), F.col("o_totalprice").alias("v"))
    prior = HierarchicalPrior([["o_orderpriority", "o_orderstatus"], ["o_orderstatus"]], "v", "o_orderkey", "yr")
    return prior.earlier(rows).select("o_orderkey", r("prior", 4).alias("prior"), "prior_support")
