"""As-of and trailing operators over ordered histories: one row a user and day, days as integers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import splits
from tidemark.operators import windows as W
from tidemark.plans.registry import plan

# The value of errors counts as missing, so that nulls are part of every history.
_H = """h AS (SELECT user_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS day, event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS v
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) = 1)"""
_W = "PARTITION BY user_id ORDER BY day"


def history(t):
    e = t.events.select("user_id", W.day_number("ts").alias("day"), "event_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return W.one_per_day(e, "user_id", "day", "event_id")


def r(x, n: int = 6):
    return F.round(x, n)


@plan(f"""WITH {_H}, d AS (SELECT *, v - lag(v) OVER ({_W}) AS dv FROM h)
SELECT user_id, day, round(lag(v) OVER ({_W}), 6) AS prev, round(dv, 6) AS dv, round(sum(v) OVER ({_W} ROWS UNBOUNDED PRECEDING), 4) AS total,
round(avg(v) OVER ({_W} ROWS UNBOUNDED PRECEDING), 6) AS mean_so_far, CASE WHEN v IS NOT NULL THEN max(v) OVER ({_W} ROWS UNBOUNDED PRECEDING) END AS peak,
round(CASE WHEN v IS NOT NULL THEN max(v) OVER ({_W} ROWS UNBOUNDED PRECEDING) END - v, 6) AS recovery,
CAST(row_number() OVER ({_W}) AS INTEGER) AS ordinal, coalesce(CAST(abs(dv) > 1e-9 AS INTEGER), 0) AS changed,
CASE WHEN row_number() OVER ({_W}) > 1 THEN coalesce(CAST(dv > 0 AS INTEGER), 0) END AS worsened FROM d""")
def running_measures(t):
    k = "user_id"
    return history(t).select(
        k, "day", r(W.lagged("v", k)).alias("prev"), r(W.change("v", k)).alias("dv"), r(W.running_sum("v", k), 4).alias("total"),
        r(W.running_mean("v", k)).alias("mean_so_far"), W.running_max("v", k).alias("peak"), r(W.recovery("v", k)).alias("recovery"),
        W.ordinal(k).alias("ordinal"), W.changed("v", k).alias("changed"), W.worsened("v", k).alias("worsened"),
    )


def _slope_sql(n: int) -> str:
    w = f"{_W} RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING"
    return f"(v - first_value(v IGNORE NULLS) OVER ({w})) / ((day - first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER ({w})) / 30.4375)"


@plan(f"""WITH {_H} SELECT user_id, day, round({_slope_sql(3)}, 10) AS velocity_3, round({_slope_sql(7)}, 10) AS velocity_7, round({_slope_sql(14)}, 10) AS velocity_14,
round({_slope_sql(3)} - {_slope_sql(7)}, 10) AS acceleration FROM h""")
def trailing_velocity(t):
    k = "user_id"
    return history(t).select(k, "day", *(r(W.slope("v", k, n), 10).alias(f"velocity_{n}") for n in (3, 7, 14)), r(W.acceleration("v", k, 3, 7), 10).alias("acceleration"))


@plan(f"""WITH {_H}, d AS (SELECT *, v - lag(v) OVER ({_W}) AS dv, CAST(event_type = 'purchase' AS INTEGER) AS bought FROM h)
SELECT user_id, day, CAST(sum(bought) OVER ({_W} RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS BIGINT) AS bought_7, round(sum(v) OVER ({_W} RANGE BETWEEN 7 PRECEDING AND CURRENT ROW), 4) AS sum_7,
round(CASE WHEN count(dv) OVER ({_W} RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) >= 2 THEN stddev_samp(dv) OVER ({_W} RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) END, 4) AS std_7,
count(*) OVER ({_W} RANGE BETWEEN 14 PRECEDING AND CURRENT ROW) AS depth_14,
round((day - last_value(CASE WHEN bought = 1 THEN day END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING)) / 30.4375, 6) AS months_since,
round((day - min(CASE WHEN bought = 1 THEN day END) OVER ({_W} ROWS UNBOUNDED PRECEDING)) / 30.4375, 6) AS months_since_first FROM d""")
def trailing_measures(t):
    k = "user_id"
    h = history(t).withColumn("dv", W.change("v", k)).withColumn("bought", (F.col("event_type") == "purchase").cast("int"))
    return h.select(
        k, "day", W.trailing_count("bought", k, 7).alias("bought_7"), r(W.trailing_sum("v", k, 7), 4).alias("sum_7"), r(W.trailing_std("dv", k, 7), 4).alias("std_7"),
        W.depth(k, 14).alias("depth_14"), r(W.months_since("bought", k)).alias("months_since"), r(W.months_since_first("bought", k)).alias("months_since_first"),
    )


@plan(f"""WITH {_H}, d AS (SELECT *, v - lag(v) OVER ({_W}) AS dv FROM h), i AS (SELECT *, sum(CASE WHEN dv <= 1e-9 THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM d)
SELECT user_id, day, CAST(sum(CASE WHEN dv > 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i""")
def rising_streak(t):
    return W.streak(history(t), "v", "user_id", "streak").select("user_id", "day", "streak")


@plan(f"""WITH {_H}, p AS (SELECT *, last_value(event_type IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known,
last_value(v IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kv FROM h)
SELECT user_id, day, coalesce(CAST(event_type <> known AS INTEGER), 0) AS revised, round(coalesce(v - kv, 0.0), 6) AS change_from_known,
CAST(sum(coalesce(CAST(event_type <> known AS INTEGER), 0)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revisions FROM p""")
def revisions(t):
    k = "user_id"
    h = history(t).withColumn("revised", W.revised("event_type", k)).withColumn("change_from_known", r(W.change_from_known("v", k)))
    return h.select(k, "day", "revised", "change_from_known", W.running_sum("revised", k).alias("revisions"))


@plan(f"""WITH {_H}, x AS (SELECT user_id, day, count(v) OVER w AS n, first_value(v IGNORE NULLS) OVER w AS a, last_value(v IGNORE NULLS) OVER w AS b,
first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER w AS da, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER w AS db
FROM h WINDOW w AS ({_W} RANGE BETWEEN 10 PRECEDING AND CURRENT ROW))
SELECT user_id, day, round(CASE WHEN n >= 2 AND db > da THEN (b - a) / ((db - da) / 30.4375) END, 10) AS trend_10 FROM x""")
def two_point_trend(t):
    return history(t).select("user_id", "day", r(W.two_point_trend("v", "user_id", 10), 10).alias("trend_10"))


@plan("""SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / count(*) OVER (), 8) AS exposure FROM customer""")
def exposure_rank(t):
    from tidemark.operators.ranks import average_percent_rank

    return average_percent_rank(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "x").select("c_custkey", r("x", 8).alias("exposure"))


@plan("""SELECT c_custkey, round((rank() OVER (PARTITION BY c_mktsegment ORDER BY b) + (count(*) OVER (PARTITION BY c_mktsegment, b) - 1) / 2.0) / count(*) OVER (PARTITION BY c_mktsegment), 8) AS exposure
FROM (SELECT *, floor(c_acctbal / 100) AS b FROM customer)""")
def exposure_rank_by_segment(t):
    c = t.customer.withColumn("b", F.floor(F.col("c_acctbal") / 100))
    from tidemark.operators.ranks import average_percent_rank

    return average_percent_rank(c.select("c_custkey", "c_mktsegment", "b"), "b", "x", ["c_mktsegment"]).select("c_custkey", r("x", 8).alias("exposure"))


@plan("""SELECT o_orderkey, o_custkey, round(1.0 / count(*) OVER (PARTITION BY o_custkey), 8) AS weight FROM orders WHERE o_orderstatus <> 'P'""")
def balanced_weights(t):
    kept = t.orders.where("o_orderstatus <> 'P'")
    return kept.select("o_orderkey", "o_custkey", r(W.balanced_weight("o_custkey"), 8).alias("weight"))


@plan("""SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), quarter(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def quarter_sample(t):
    return W.quarter_last(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


@plan("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(t):
    return W.latest(t.events, "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@plan("""SELECT c_name AS name_key, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
QUALIFY row_number() OVER (PARTITION BY c_name ORDER BY o_orderdate, o_orderkey) = 1""")
def dedup_keep_first(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return W.pick(j, ["c_name"], ["o_orderdate", "o_orderkey"]).select(F.col("c_name").alias("name_key"), "o_orderkey")


@plan("""SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def dedup_keep_last(t):
    order = [F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return W.pick(t.lineitem, ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@plan("""WITH e AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS f FROM orders GROUP BY 1),
d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_custkey, max(d) AS cutoff FROM d JOIN e USING (o_custkey) WHERE d <= f - CAST(greatest(90, floor(greatest(120, f - s) / 4)) AS INTEGER) GROUP BY 1""")
def cutoff_row(t):
    day = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("d")).distinct()
    ends = day.groupBy("o_custkey").agg(F.min("d").alias("s"), F.max("d").alias("f"))
    return splits.cutoff_rows(day, ends, "o_custkey", "d", "s", "f").select("o_custkey", F.col("d").alias("cutoff"))


@plan("""SELECT CAST(o_orderdate AS DATE) >= (SELECT d FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) ORDER BY d
OFFSET (SELECT CAST(floor(count(DISTINCT CAST(o_orderdate AS DATE)) * 0.8) AS BIGINT) FROM orders) LIMIT 1) AS test, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY 1""")
def temporal_split(t):
    o = t.orders.withColumn("d", F.col("o_orderdate").cast("date"))
    train, test = splits.by_date(o, "d", 0.2)
    both = train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))
    return both.groupBy("test").agg(F.count("*").alias("n"), F.min("d").alias("first_day"))
