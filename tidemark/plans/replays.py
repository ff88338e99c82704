"""Replayed cut-offs, kept stages and parsed pages, gates and comparisons on the tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidemark.ml import crossfit, harness, promoted, retrain
from tidemark.ml import models as M
from tidemark.operators import aggregates as A
from tidemark.operators import backtest
from tidemark.operators import governance as G
from tidemark.operators.tables import folder, stored
from tidemark.plans.registry import plan
from tidemark.sources import parsed


def r(x, n: int = 6):
    return F.round(x, n)


_CUTS = [dt.date(y, 6, 30) for y in range(1996, 2002)]
_STATES = """c AS (SELECT unnest([DATE '1996-06-30', DATE '1997-06-30', DATE '1998-06-30', DATE '1999-06-30', DATE '2000-06-30', DATE '2001-06-30']) AS cutoff),
o AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders),
b AS (SELECT k, cutoff, count(v) AS n, sum(v) AS total, max(d) AS last_day, max_by(v, {'d': d, 'v': v}) FILTER (v IS NOT NULL) AS known FROM o JOIN c ON d <= cutoff GROUP BY 1, 2),
a AS (SELECT k, cutoff, min(d) AS next_day, min_by(v, {'d': d, 'v': v}) AS actual FROM o JOIN c ON d > cutoff WHERE v IS NOT NULL GROUP BY 1, 2),
s AS (SELECT b.*, CASE WHEN next_day - cutoff <= 365 THEN next_day END AS next_day, CASE WHEN next_day - cutoff <= 365 THEN actual END AS actual FROM b LEFT JOIN a USING (k, cutoff))"""


def _states(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    return backtest.replay(rows, _CUTS, "k", "d", "v", horizon=365)


@plan(f"WITH {_STATES} SELECT k, cutoff, n, round(total, 4) AS total, last_day, known, next_day, actual FROM s")
def cutoff_replay(t):
    """What was known of each customer at six cut-offs, and the next price within a year."""
    return _states(t).select("k", "cutoff", "n", r("total", 4).alias("total"), "last_day", "known", "next_day", "actual")


@plan(f"""WITH {_STATES}, p AS (SELECT cutoff, coalesce(total / n, 0) AS predicted, actual FROM s WHERE actual IS NOT NULL)
SELECT cutoff, count(*) AS rows, round(avg(abs(actual - predicted)), 4) AS mae, round(avg(greatest(0, 100 - abs(predicted - actual) / greatest(abs(actual), 1) * 100)), 6) AS accuracy,
count(*) FILTER (actual >= 300000 AND predicted >= 300000) AS true_positive, count(*) FILTER (actual < 300000 AND predicted >= 300000) AS false_positive,
count(*) FILTER (actual >= 300000 AND predicted < 300000) AS false_negative FROM p GROUP BY 1""")
def cutoff_report(t):
    """The mean price so far against the next one, by cut-off, and how well it tells dear orders."""
    mean = F.coalesce(F.col("total") / F.col("n"), F.lit(0.0))
    found = backtest.report(backtest.predictions(_states(t), "k", mean), 300000.0)
    return found.select("cutoff", "rows", r("mae", 4).alias("mae"), r("accuracy").alias("accuracy"), "true_positive", "false_positive", "false_negative")


def _folded(prices, folds):
    return crossfit.out_of_fold_means(prices, ["l_returnflag"], "l_orderkey", "y", "w", folds)


def _errors(folded, bound):
    both = folded.withColumn("e", F.abs(F.col("y") - F.col("prediction")))
    return both.groupBy("fold").agg(F.count("*").alias("rows"), (F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("mae"), F.count_if(F.col("e") > bound).alias("wide"))


@plan("""WITH p AS (SELECT l_orderkey, l_returnflag, l_extendedprice AS y, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS w, CAST(('0x' || substring(md5('7|' || l_orderkey), 1, 8)) AS BIGINT) % 4 AS fold FROM lineitem),
c AS (SELECT l_returnflag, fold, sum(w * y) AS s, sum(w) AS n FROM p GROUP BY 1, 2),
m AS (SELECT a.l_returnflag, a.fold, sum(b.s) / sum(b.n) AS mean FROM c a JOIN c b ON a.l_returnflag = b.l_returnflag AND a.fold <> b.fold GROUP BY 1, 2)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS rows, round(sum(w * abs(y - mean)) / sum(w), 4) AS mae, count(*) FILTER (abs(y - mean) > 50000) AS wide, true AS second_run_reused FROM p JOIN m USING (l_returnflag, fold) GROUP BY 1""")
def experiment_stages(t):
    """An experiment of two stages, run twice: the second run reads what the first has kept."""
    from tidemark.plans.estimates import _prices

    stages = [harness.Stage("folded", _folded, ("prices",), {"folds": 4}), harness.Stage("errors", _errors, ("folded",), {"bound": 50000})]
    root, prices = f"{folder(t.spark)}/experiments-{uuid.uuid4().hex}", stored(_prices(t), "prices")
    marks = {"prices": G.fingerprint(prices).first()["digest"]}  # of all rows, once for both runs
    harness.run(t.spark, stages, {"prices": prices}, root, marks)
    again = harness.run(t.spark, stages, {"prices": prices}, root, marks)
    return again["errors"].frame.select("fold", "rows", r("mae", 4).alias("mae"), "wide", F.lit(all(o.reused for o in again.values())).alias("second_run_reused"))


@plan(r"""SELECT digest, links FROM (SELECT sha256(html) AS digest, len(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=')) AS links FROM (SELECT DISTINCT html FROM pages WHERE html IS NOT NULL)) WHERE links > 0""")
def pages_parsed_once(t):
    """Links by page content: half of the pages are parsed, then all of them, of which only the rest is new."""
    pages = t.pages.where("html IS NOT NULL").select("html", F.sha2("html", 256).alias("digest"), "page_id")

    def links(files):
        return files.select("digest", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href\s*="), 0)).alias("link"))

    root = f"{folder(t.spark)}/parsed-{uuid.uuid4().hex}"
    parsed.parse_new(pages.where("page_id % 2 = 0"), links, root, "links", "1")
    parsed.parse_new(pages, links, root, "links", "1")
    return parsed.parsed(t.spark, root, "links", "1").groupBy("digest").agg(F.count("*").alias("links"))


@plan("""WITH e AS (SELECT o_custkey, avg(((o_totalprice > 100000)::INT + (o_orderstatus <> 'P')::INT) / 2.0::DOUBLE) AS share, count(*) AS n FROM orders GROUP BY 1),
g AS (SELECT o_custkey FROM e ORDER BY round(share, 12) DESC, n DESC, o_custkey LIMIT 100)
SELECT o_orderkey, o_custkey IN (SELECT o_custkey FROM g) AS calibration_gate FROM orders""")
def evidence_gate(t):
    """Orders of the hundred customers of most evidence: the mean share of what is known of their orders, then their number."""
    seen = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") > 100000, 1).alias("a"), F.when(F.col("o_orderstatus") != "P", 1).alias("b"))
    return promoted.evidence_gate(seen, "o_custkey", ["a", "b"], 100).select("o_orderkey", "calibration_gate")


def _delays(t):
    day = F.col("o_orderdate").cast("date")
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    planned = F.when(F.col("o_orderstatus") != "P", F.date_add(day, 60))
    return stored(
        lines.select(
            F.col("l_orderkey").alias("entity"), "l_linenumber", F.year("l_shipdate").alias("yr"), day.alias("snapshot"), planned.alias("planned"), "l_quantity",
            F.col("o_orderpriority").alias("office"), F.col("l_returnflag").alias("stage"), F.datediff(F.col("l_shipdate").cast("date"), F.date_add(day, 60)).cast("double").alias("delay"), F.lit(1.0).alias("weight"),
        ).where("yr IS NOT NULL"), "delays",
    )


@plan()
def composed_delay_model(t):
    """Prior, line, days left, corrections and gate as one pipeline, trained on the years before the last, on the last."""
    rows = _delays(t)
    last = rows.agg(F.max("yr")).first()[0]
    model = promoted.delay_model(rows.where(F.col("yr") < last), M.Features(("l_quantity",), ("stage",)), "delay", "weight", "yr", "entity", "stage", "snapshot", "planned", [["office"]], folds=2)
    held = model.transform(rows.where(F.col("yr") == last))
    metrics = A.regression_metrics("delay", "prediction", "weight")
    return held.groupBy(F.col("planned").isNotNull().alias("dated")).agg(metrics["rows"].alias("rows"), r(metrics["mae"], 2).alias("mae"))


@plan()
def models_compared(t):
    """Two models of other years on the rows that neither has seen."""
    rows = _delays(t)
    years = [x[0] for x in rows.select("yr").distinct().orderBy("yr").collect()]  # a row a year
    own = M.Features(("l_quantity",), ("stage", "office"))
    seen = {"early": rows.where(F.col("yr") <= years[1]), "all but the last two": rows.where(F.col("yr") < years[-2])}
    models = {n: (M.fit(part, own, M.families("delay", "weight")["linear"]), own) for n, part in seen.items()}
    found = retrain.compared(rows, models, "delay", "weight", "entity", {n: part.select("entity") for n, part in seen.items()})
    return found.select("model", "rows", "entities", r("mae", 3).alias("mae"), "wins")
