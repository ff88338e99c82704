"""Coercions, eligibility, readers and writers, merged entries, digests and decisions on the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import aggregates as A
from tidemark.operators import governance as G
from tidemark.operators.tables import folder
from tidemark.plans import trajectories as T
from tidemark.plans.models import _book
from tidemark.plans.registry import plan
from tidemark.sources import tables as S


def r(x, n: int = 6):
    return F.round(x, n)


def _scratch(t, name: str) -> str:
    return f"{folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@plan("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def date_coercion(t):
    """Dates from text: what has another form, or says that there is none, is null."""
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "dd/MM/yyyy")).otherwise("not published")
    return t.orders.select("o_orderkey", text.alias("text")).select("o_orderkey", X.timestamp_or_null("text").cast("date").alias("day"))


@plan("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN d END, CASE WHEN o_totalprice > 100000 THEN d - 30 END) AS start,
CASE WHEN o_orderstatus <> 'P' THEN 'planned' WHEN o_totalprice > 100000 THEN 'approval' END AS start_source FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def start_and_source(t):
    """The first known of several dates, and which it is."""
    day = F.col("o_orderdate").cast("date")
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", day).alias("planned"), F.when(F.col("o_totalprice") > 100000, F.date_sub(day, 30)).alias("approval"))
    return rows.select("o_orderkey", F.coalesce("planned", "approval").alias("start"), X.first_known("planned", "approval").alias("start_source"))


@plan("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount <> 0 THEN l_tax END AS share FROM lineitem""")
def finite_values(t):
    """Infinite values and those that are no number become null."""
    odd = F.when(F.col("l_discount") == 0, F.when(F.col("l_linenumber") % 2 == 0, float("inf")).otherwise(float("nan"))).otherwise(F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.finite(odd).alias("share"))


@plan("""WITH e AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS d, CAST(l_partkey AS VARCHAR) || '-' || l_suppkey || '-' || l_quantity::INT AS tie FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'P' AND l_discount <> 0 AND CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + 900),
q AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY l_orderkey, year(d), quarter(d) ORDER BY d DESC, tie DESC) = 1)
SELECT l_orderkey, d AS snapshot, round(1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey), 9) AS weight FROM q""")
def eligible_rows(t):
    """Verified rows before completion that have both targets, the last of each quarter, weighing 1 an entity."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    tie = F.concat_ws("-", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    rows = lines.select(
        F.col("l_orderkey").alias("canonical_id"), F.col("l_shipdate").cast("date").alias("snapshot_date"), F.date_add(F.col("o_orderdate").cast("date"), 900).alias("completion_date"),
        (F.col("o_orderstatus") != "P").alias("verified"), F.nullif("l_discount", F.lit(0.0)).alias("final_cost_overrun_pct"), F.col("l_tax").alias("final_delay_days"), tie.alias("source_report"),
    )
    return T.training_rows(rows).select(F.col("canonical_id").alias("l_orderkey"), F.col("snapshot_date").alias("snapshot"), r("sample_weight", 9).alias("weight"))


@plan("""SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus <> 'P'""")
def csv_round_trip(t):
    """Rows written as CSV and read back by a schema; a second writer leaves what is there."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    path = _scratch(t, "csv")
    S.write_csv(rows.where("o_orderstatus <> 'P'").drop("o_orderstatus"), path)
    S.write_csv(rows.drop("o_orderstatus"), path, only_if_absent=True)
    return S.read_csv(t.spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double, day date")


@plan("""SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS project_code, CAST(o_orderdate AS DATE) AS snapshot_date, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS revised_completion_date, o_totalprice AS spent FROM orders""")
def history_scan(t):
    """Histories as text: ids keep their zeros, what isn't a day is null, figures are figures."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = t.orders.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("project_code"), day.alias("snapshot_date"), F.when(F.col("o_orderstatus") == "F", day).otherwise("soon").alias("revised_completion_date"), F.col("o_totalprice").alias("spent"))
    path = _scratch(t, "history")
    S.write_csv(rows, path)
    return S.read_history(t.spark, path)


@plan("""SELECT c.o_orderkey, coalesce(CASE WHEN c.o_totalprice > 200000 THEN c.o_orderstatus END, p.o_orderstatus) AS status, p.o_orderpriority AS version FROM orders c LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) p USING (o_orderkey)""")
def manifest_merge(t):
    """Current entries with what earlier ones knew; the earlier ones lie in a JSON manifest."""
    path = _scratch(t, "manifest")
    t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("version")).write.json(path)
    now = t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 200000, F.col("o_orderstatus")).alias("status"))
    return S.merged_manifest(t.spark.read.json(path), now, ["o_orderkey"], ["status", "version"]).select("o_orderkey", "status", "version")


@plan("""SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2, count(*) AS rows FROM (SELECT l_extendedprice AS y, nullif(l_tax, 0) * 0 + l_quantity * 2000 AS p FROM lineitem) WHERE y IS NOT NULL AND p IS NOT NULL""")
def unweighted_metrics(t):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.nullif("l_tax", F.lit(0.0)) * 0 + F.col("l_quantity") * 2000).alias("p"))
    m = A.regression_metrics("y", "p")
    return rows.agg(r(m["mae"], 4).alias("mae"), r(m["rmse"], 4).alias("rmse"), r(m["r2"]).alias("r2"), m["rows"].alias("rows"))


@plan("""SELECT m AS month, row_number() OVER (ORDER BY n) AS place, c AS orders FROM (SELECT monthname(o_orderdate) AS m, month(o_orderdate) AS n, count(*) AS c FROM orders GROUP BY 1, 2)""")
def months_by_name(t):
    """Months in the order of the year, told from their names alone."""
    from pyspark.sql import Window

    named = t.orders.groupBy(F.date_format("o_orderdate", "MMMM").alias("month")).agg(F.count("*").alias("orders"))
    number = F.month(F.try_to_timestamp("month", F.lit("MMMM")))
    return named.select("month", F.row_number().over(Window.orderBy(number)).cast("long").alias("place"), "orders")  # twelve rows


@plan("""SELECT sha256('as_of,entity,weight|' || count(*) || '|' || sum(CAST(('0x' || substring(h, 1, 12)) AS HUGEINT)) || '|' || sum(CAST(('0x' || substring(h, 13, 12)) AS HUGEINT))) AS digest
FROM (SELECT sha256(strftime(CAST(o_orderdate AS DATE), '%Y-%m-%dT00:00:00') || chr(31) || o_orderkey || chr(31) || '1.00000000000') AS h FROM orders)""")
def cohort_digest(t):
    """Who is in a ledger and with what weight, whatever was predicted."""
    return G.ledger(_book(t)).select("entity", "as_of", "weight").transform(G.fingerprint).select("digest")


@plan("""SELECT o_custkey AS experiment, o_orderpriority AS run, round(gain, 6) AS gain, coalesce(gain >= 10, false) AS promote FROM (SELECT *, CASE WHEN b <> 0 THEN (b - c) / b * 100 END AS gain
FROM (SELECT o_custkey, o_orderpriority, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END AS b, o_totalprice * (0.8 + o_orderkey % 4 * 0.05) AS c FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) = 1)""")
def registry_decisions(t):
    """The latest entry of each experiment and run, and whether its gain suffices."""
    runs = t.orders.select(
        F.col("o_custkey").alias("experiment"), F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("recorded_at"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(0.0).alias("baseline"), (F.col("o_totalprice") * (0.8 + F.col("o_orderkey") % 4 * 0.05)).alias("challenger"),
    )
    return G.decisions(runs).select("experiment", "run", r("gain").alias("gain"), "promote")
