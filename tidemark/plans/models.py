"""Model and evidence plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.ml import models as M
from tidemark.operators import governance as G
from tidemark.operators import windows as W
from tidemark.operators.tables import stored
from tidemark.plans.registry import plan

_FEATURES = M.Features(("l_quantity", "l_discount", "l_tax"), ("l_returnflag",))


def _rows(t):
    return t.lineitem.select("l_orderkey", "l_quantity", "l_discount", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), "l_returnflag", F.col("l_extendedprice").alias("y"), F.year("l_shipdate").alias("yr")).withColumn("w", W.balanced_weight("l_orderkey"))


@plan()
def model_selection(t):
    """Scores of the families on the last year, trained on the years before."""
    _, _, scores = M.selected(stored(_rows(t), "prices"), _FEATURES, "y", "w", "yr")
    return scores.select("family", F.round("mae", 3).alias("mae"), F.round("r2", 4).alias("r2"), "rows")


@plan()
def residual_bands(t):
    rows = _rows(t)
    last = rows.agg(F.max("yr")).first()[0]
    model = M.fit(rows.where(F.col("yr") < last), _FEATURES, M.families("y", "w")["linear"])
    return M.bands(M.predict(model, rows.where(F.col("yr") == last), _FEATURES), "y", "prediction")


_GRID = "(SELECT i / 10.0 AS a, j / 10.0 AS b, (10 - i - j) / 10.0 AS c FROM range(11) x(i), range(11) z(j) WHERE i + j <= 10)"


@plan(f"""SELECT round(mae, 6) AS mae, a AS w_p, b AS w_q, c AS w_r FROM (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, round(sum(w * abs(y - (a * p + b * q + c * r))) / sum(w), 9) AS mae
FROM (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p, 50000.0 AS q, l_extendedprice * 0.5 + 30000 AS r, 1.0 / count(*) OVER (PARTITION BY l_orderkey) AS w FROM lineitem), {_GRID} GROUP BY ALL) ORDER BY mae, a, b LIMIT 1""")
def blend_grid(t):
    rows = _rows(t).select("y", (F.col("l_quantity") * 1500.0).alias("p"), F.lit(50000.0).alias("q"), (F.col("y") * 0.5 + 30000).alias("r"), "w")
    best = M.best_blend(rows, ["p", "q", "r"], "y", "w")
    return best.select(F.round("mae", 6).alias("mae"), "w_p", "w_q", "w_r")


def _book(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("entity"), d.alias("as_of"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("sector"),
        F.lit(1.0).alias("weight"), F.col("o_totalprice").alias("actual"), F.lit(250000.0).alias("baseline"), (F.col("o_totalprice") * 0.9).alias("challenger"),
    )


@plan("""SELECT CAST(o_orderkey AS VARCHAR) AS entity, CAST(o_orderdate AS DATE) AS as_of, round(abs(250000 - o_totalprice), 4) AS baseline_error, round(abs(o_totalprice * 0.9 - o_totalprice), 4) AS challenger_error,
round(abs(250000 - o_totalprice) - abs(o_totalprice * 0.9 - o_totalprice), 4) AS improvement FROM orders""")
def ledger_build(t):
    book = G.ledger(_book(t))
    return book.select("entity", "as_of", *(F.round(c, 4).alias(c) for c in ("baseline_error", "challenger_error", "improvement")))


@plan("""WITH k AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n, count(*) FILTER (o_totalprice < 10000) AS m, count(*) FILTER (o_orderkey % 50 = 0) AS w FROM orders GROUP BY ALL)
SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS doubled, CAST(coalesce(sum(m), 0) AS BIGINT) AS missing, CAST(coalesce(sum(w), 0) AS BIGINT) AS bad_weight FROM k""")
def ledger_checks(t):
    """A book with faults in it: by customer, with orders of one day doubled, small values missing and some weights 0."""
    flawed = _book(t).withColumn("actual", F.when(F.col("actual") >= 10000, F.col("actual"))).withColumn("weight", F.when(F.col("entity").cast("long") % 50 == 0, 0.0).otherwise(1.0))
    keys = t.orders.select(F.col("o_orderkey").cast("string").alias("entity"), F.col("o_custkey").cast("string").alias("customer"))
    return G.ledger_faults(G.ledger(flawed.join(keys, "entity").drop("entity").withColumnRenamed("customer", "entity")))


@plan("""SELECT count(*) AS rows, sha256('c_custkey,c_mktsegment,c_name|' || count(*) || '|' || sum(CAST(('0x' || substring(h, 1, 12)) AS HUGEINT)) || '|' || sum(CAST(('0x' || substring(h, 13, 12)) AS HUGEINT))) AS digest
FROM (SELECT sha256(c_custkey || chr(31) || c_mktsegment || chr(31) || c_name) AS h FROM customer)""")
def cohort_fingerprint(t):
    return G.fingerprint(t.customer, ["c_name", "c_custkey", "c_mktsegment"])
