"""Read queries: summaries, rankings, replay, assistant routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators.ranks import average_percent_rank, quantiles
from tidemark.operators import windows as W
from tidemark.plans.registry import plan


def r(x, n: int = 6):
    return F.round(x, n)


_S = """s AS (SELECT c_custkey, c_mktsegment, orders, spent, last_gap, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal,
(rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / count(*) OVER () AS exposure FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent, CAST(DATE '2001-08-01' - CAST(max(o_orderdate) AS DATE) AS INTEGER) AS last_gap FROM orders GROUP BY 1) ON c_custkey = o_custkey),
p AS (SELECT *, 100 * (0.45 * coalesce(least(1.0, greatest(0.0, last_gap / 730.0)), 0) + 0.35 * coalesce(least(1.0, greatest(0.0, bal / 10000 * 40 / 40)), 0) + 0.20 * exposure) AS score FROM s)"""


def scored(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"), r(F.sum("o_totalprice"), 2).alias("spent"), F.datediff(F.lit("2001-08-01").cast("date"), F.max("o_orderdate").cast("date")).alias("last_gap")
    )
    c = average_percent_rank(t.customer, "c_acctbal", "exposure").join(o, "c_custkey", "left")
    c = c.withColumn("bal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return c.withColumn("score", X.priority_score("last_gap", F.col("bal") / 10000 * 40, "exposure"))


@plan(f"""WITH {_S} SELECT c_custkey, round(score, 4) AS score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 65 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS level,
round((CAST(orders IS NOT NULL AS INTEGER) + CAST(bal IS NOT NULL AS INTEGER)) / 2.0, 6) AS completeness FROM p ORDER BY round(score, 4) DESC, c_custkey LIMIT 20""")
def topk_priority(t):
    s = scored(t).withColumn("score", r("score", 4))
    out = s.select("c_custkey", "score", X.priority_level("score").alias("level"), r(X.completeness("orders", "bal")).alias("completeness"))
    return out.orderBy(F.col("score").desc(), "c_custkey").limit(20)


@plan(f"""WITH {_S}, l AS (SELECT CASE WHEN score >= 80 THEN 'critical' WHEN score >= 65 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS level FROM p)
SELECT v.level, count(l.level) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('unknown')) v(level) LEFT JOIN l USING (level) GROUP BY 1""")
def level_histogram(t):
    levels = t.spark.createDataFrame([(x,) for x in ("critical", "high", "medium", "low", "unknown")], "level string")
    n = scored(t).groupBy(X.priority_level("score").alias("level")).agg(F.count("*").alias("n"))
    return levels.join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


@plan("""SELECT count(*) AS customers, round(sum(coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0)), 2) AS positive_balance, count(DISTINCT c_nationkey) AS nations, count(*) FILTER (c_acctbal < 0) AS overdrawn FROM customer""")
def portfolio_summary(t):
    b = F.col("c_acctbal")
    return t.customer.agg(
        F.count("*").alias("customers"), r(F.sum(F.coalesce(F.when(b > 0, b), F.lit(0.0))), 2).alias("positive_balance"),
        F.countDistinct("c_nationkey").alias("nations"), F.count(F.when(b < 0, 1)).alias("overdrawn"),
    )


@plan("""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC LIMIT 3""")
def sector_topk(t):
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
    return g.orderBy(F.col("total").desc()).limit(3)


@plan("""SELECT c_custkey, c_acctbal, last_order FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_order FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON c_custkey = o_custkey
ORDER BY last_order ASC NULLS LAST, c_acctbal DESC, c_custkey LIMIT 50""")
def mixed_sort(t):
    o = t.orders.where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("date").alias("last_order"))
    c = t.customer.join(o, "c_custkey", "left").select("c_custkey", "c_acctbal", "last_order")
    return c.orderBy(F.asc_nulls_last("last_order"), F.col("c_acctbal").desc(), "c_custkey").limit(50)


@plan("""SELECT s_suppkey, s_acctbal FROM supplier ORDER BY abs(s_acctbal) NULLS LAST, s_suppkey LIMIT 25""")
def sort_by_magnitude(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.abs("s_acctbal").asc_nulls_last(), "s_suppkey").limit(25)


@plan("""SELECT s_suppkey, s_acctbal FROM supplier ORDER BY abs(s_acctbal) DESC NULLS LAST, s_suppkey LIMIT 25""")
def largest_magnitudes(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.abs("s_acctbal").desc_nulls_last(), "s_suppkey").limit(25)


@plan("""SELECT event_type, impact, round(abs(impact) / sum(abs(impact)) OVER () * 100, 4) AS share FROM (SELECT event_type, round(avg(value) - (SELECT avg(value) FROM events), 6) AS impact FROM events GROUP BY 1)
QUALIFY row_number() OVER (ORDER BY abs(impact) DESC, event_type) <= 3""")
def top_factors(t):
    whole = t.events.agg(F.avg("value").alias("g"))
    f = t.events.groupBy("event_type").agg(F.avg("value").alias("m")).join(F.broadcast(whole)).select("event_type", r(F.col("m") - F.col("g")).alias("impact"))  # one row
    total = f.agg(F.sum(F.abs("impact")).alias("s"))
    f = f.join(F.broadcast(total)).select("event_type", "impact", r(F.abs("impact") / F.col("s") * 100, 4).alias("share"))
    return f.orderBy(F.abs("impact").desc(), "event_type").limit(3)


@plan("""SELECT user_id, min_by(event_type, ts) AS first_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 3""")
def history_index(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_type", "ts").alias("first_type"), F.count("*").alias("n")).where("n >= 3")


@plan("""WITH b AS (SELECT o_orderkey, o_totalprice, o_totalprice * CASE WHEN o_orderpriority = '1-URGENT' THEN 1.1 ELSE 1 END AS changed FROM orders)
SELECT CASE WHEN o_totalprice < 250000 THEN 'below' ELSE 'above' END AS before, CASE WHEN changed < 250000 THEN 'below' ELSE 'above' END AS after, count(*) AS n FROM b GROUP BY 1, 2""")
def scenario_override(t):
    """An override takes effect: prices of urgent orders rise by a tenth, and the bands before and after are compared."""
    changed = F.col("o_totalprice") * F.when(F.col("o_orderpriority") == "1-URGENT", 1.1).otherwise(1.0)
    side = lambda x: F.when(x < 250000, "below").otherwise("above")
    return t.orders.groupBy(side(F.col("o_totalprice")).alias("before"), side(changed).alias("after")).agg(F.count("*").alias("n"))


@plan("""SELECT o_custkey, CAST(sum(CAST(o_totalprice > 300000 AS INTEGER)) AS BIGINT) AS eligible, count(*) AS n, round(sum(CAST(o_totalprice > 300000 AS INTEGER)) / count(*), 6) AS ratio FROM orders GROUP BY 1
ORDER BY eligible DESC, ratio DESC, n DESC, o_custkey LIMIT 688""")
def evidence_coverage(t):
    big = (F.col("o_totalprice") > 300000).cast("int")
    g = t.orders.groupBy("o_custkey").agg(F.sum(big).alias("eligible"), F.count("*").alias("n"), r(F.sum(big) / F.count("*")).alias("ratio"))
    return g.orderBy(F.desc("eligible"), F.desc("ratio"), F.desc("n"), "o_custkey").limit(688)


@plan("""SELECT user_id, day, n FROM (SELECT user_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS day, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 2""")
def tail_of_history(t):
    d = t.events.groupBy("user_id", W.day_number("ts").alias("day")).agg(F.count("*").alias("n"))
    return W.pick(d, ["user_id"], [F.desc("day")], 2)


@plan("""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderpriority, quantile_cont(o_totalprice, 0.25) OVER () AS q FROM orders)
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' AND o_totalprice < q THEN 'refined' ELSE 'base' END AS route FROM o""")
def routed(t):
    q = quantiles(t.orders, "o_totalprice", {"q": 0.25})
    low = (F.col("o_orderpriority") != "5-LOW") & (F.col("o_totalprice") < F.col("q"))
    return t.orders.join(F.broadcast(q)).select("o_orderkey", F.when(low, "refined").otherwise("base").alias("route"))  # one row
