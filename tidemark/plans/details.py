"""Smaller operators on the tables: flags, parsing, labels, eligibility, forward labels, path features."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import expr as X
from tidemark.operators import splits
from tidemark.operators import windows as W
from tidemark.plans.histories import _H, _W, history
from tidemark.plans.registry import plan
from tidemark.sources.tables import month_spine, strict_json


def r(x, n: int = 6):
    return F.round(x, n)


@plan("""SELECT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(CAST(l_extendedprice > o_totalprice AS INTEGER), 0) AS over_total, coalesce(CAST(l_shipdate < o_orderdate AS INTEGER), 0) AS before_order,
CAST(nullif(l_tax, 0) IS NULL AS INTEGER) AS no_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE over_total + before_order + no_tax >= 2""")
def dq_flags(t):
    """Rows with two flags or more; a comparison with a missing value raises none."""
    flag = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", flag(F.col("l_extendedprice") > F.col("o_totalprice")).alias("over_total"),
        flag(F.col("l_shipdate") < F.col("o_orderdate")).alias("before_order"), F.nullif("l_tax", F.lit(0.0)).isNull().cast("int").alias("no_tax"),
    )
    return j.where("over_total + before_order + no_tax >= 2")


_TEXT = "CASE p_size % 6 WHEN 0 THEN '1,2' || p_size || '.50' WHEN 1 THEN '(-)' WHEN 2 THEN ' N.A. ' WHEN 3 THEN '(' || p_size || ')' WHEN 4 THEN 'x' || p_size ELSE '-' || p_size END"


@plan(f"""SELECT p_partkey, s AS printed, CASE WHEN lower(trim(s)) IN ('', '-', '(-)', 'n.a.', 'na') THEN NULL ELSE TRY_CAST(regexp_replace(trim(s), '[,\\[\\]()]', '', 'g') AS DOUBLE) END AS parsed,
lower(trim(s)) IN ('', '-', '(-)', 'n.a.', 'na') AS placeholder FROM (SELECT p_partkey, {_TEXT} AS s FROM part)""")
def number_parsing(t):
    return t.part.select("p_partkey", F.expr(_TEXT).alias("printed")).select("p_partkey", "printed", X.number("printed").alias("parsed"), X.is_placeholder("printed").alias("placeholder"))


@plan("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END AS part_number, '200' || (p_size % 9) || '_2015' AS run FROM part""")
def labels_from_names(t):
    name = F.expr("CASE p_size % 4 WHEN 0 THEN 'April part-1' WHEN 1 THEN 'May (Part II)' WHEN 2 THEN 'part iv' ELSE 'June' END")
    run = F.expr("concat('monthly-200', p_size % 9, '-2015')")
    return t.part.select("p_partkey", X.part_number(name).alias("part_number"), X.run_key(run).alias("run"))


@plan("""SELECT o_orderkey, CASE WHEN d >= 365 THEN round(d / 365.0::DOUBLE, 1) || ' years' WHEN d >= 30 THEN round(d / 30.0::DOUBLE, 1) || ' months' ELSE d || ' days' END AS span
FROM (SELECT o_orderkey, CAST(DATE '2001-08-02' - CAST(o_orderdate AS DATE) AS INTEGER) AS d FROM orders)""")
def span_labels(t):
    d = F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", X.span_label(d).alias("span"))


@plan(f"""WITH {_H} SELECT user_id, day, v FROM (SELECT *, count(v) OVER ({_W} RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS n FROM h) WHERE n >= 4""")
def history_depth_filter(t):
    n = F.count("v").over(W.trailing("user_id", 7))
    return history(t).withColumn("n", n).where("n >= 4").select("user_id", "day", "v")


@plan(f"""WITH {_H}, d AS (SELECT *, v - lag(v) OVER ({_W}) AS dv, lag(v) OVER ({_W}) AS pv FROM h)
SELECT user_id, day, round(sum(coalesce(CASE WHEN pv > 0 THEN abs(dv) / pv * 100 END, 0.0)) OVER ({_W} ROWS UNBOUNDED PRECEDING), 4) AS revised_pct,
round(avg(CAST(dv > 0 AS INTEGER)) OVER ({_W} ROWS UNBOUNDED PRECEDING), 8) AS rising_share, round((day - min(day) OVER ({_W} ROWS UNBOUNDED PRECEDING)) / 30.4375, 8) AS months_observed FROM d""")
def path_features(t):
    k = "user_id"
    h = history(t).withColumn("dv", W.change("v", k)).withColumn("pv", W.lagged("v", k))
    part = F.coalesce(F.when(F.col("pv") > 0, F.abs("dv") / F.col("pv") * 100), F.lit(0.0))
    rising = (F.col("dv") > 0).cast("int")
    return h.withColumn("part", part).withColumn("rising", rising).select(k, "day", r(W.running_sum("part", k), 4).alias("revised_pct"), r(W.running_mean("rising", k), 8).alias("rising_share"), r(W.months_observed(k), 8).alias("months_observed"))


@plan("""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice - 250000) * count(*) / (count(*) + 5), 3) AS correction FROM orders GROUP BY 1""")
def shrunk_residual_mean(t):
    n = F.count("*")
    return t.orders.groupBy("o_orderpriority").agg(n.alias("n"), r(F.avg(F.col("o_totalprice") - 250000) * n / (n + 5), 3).alias("correction"))


@plan("""SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL ORDER BY yr, o_orderstatus""")
def value_counts(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("yr"), "o_orderstatus").agg(F.count("*").alias("n")).orderBy("yr", "o_orderstatus")


@plan("""WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2)
SELECT conv_id, string_agg(role, ' | ' ORDER BY t) AS roles, count(*) AS n FROM f GROUP BY 1""")
def ordered_distinct(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    roles = F.array_distinct(F.transform(rows, lambda x: x["role"]))
    return t.conversations.groupBy("conv_id").agg(F.array_join(roles, " | ").alias("roles"), F.size(roles).cast("long").alias("n"))


@plan(r"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '') AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def url_parts(t):
    u = F.col("url")
    return t.pages.select("page_id", F.try_parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.nullif(F.try_parse_url(u, F.lit("PATH")), F.lit("")).alias("path"), F.nullif(F.try_parse_url(u, F.lit("QUERY"), F.lit("page")), F.lit("")).alias("page"))


@plan("""SELECT c_custkey, '{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS json FROM customer""")
def json_rows(t):
    out = strict_json(t.customer.select("c_name", "c_nationkey")).select("json", F.get_json_object("json", "$.c_name").alias("c_name"))
    return out.join(t.customer.select("c_name", "c_custkey"), "c_name").select("c_custkey", "json")


@plan("""SELECT o_custkey, count(*) AS months, min(m) AS first_month FROM (SELECT o_custkey, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS m
FROM (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)) GROUP BY 1""")
def months_spine(t):
    ends = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return month_spine(t.spark, ends, "a", "b").groupBy("o_custkey").agg(F.count("*").alias("months"), F.min("month").alias("first_month"))


@plan("""SELECT o_orderkey, CAST(nxt - d AS INTEGER) AS days_to_next, coalesce(nxt - d <= 180, false) AS within_half_year FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders)""")
def forward_labels(t):
    """What happened after each row: labels only, never features."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t.orders.withColumn("d", F.col("o_orderdate").cast("date")).withColumn("nxt", F.lead("o_orderdate").over(w).cast("date"))
    gap = F.datediff("nxt", "d")
    return o.select("o_orderkey", gap.alias("days_to_next"), F.coalesce(gap <= 180, F.lit(False)).alias("within_half_year"))


@plan("""WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y)
SELECT yr FROM b WHERE n >= 3 AND before >= 10 ORDER BY yr DESC LIMIT 3""")
def rolling_folds(t):
    folds = splits.rolling_folds(t.orders.withColumn("yr", F.year("o_orderdate")), "yr", "o_custkey")
    return t.spark.createDataFrame([(y,) for y in folds], "yr int")


@plan("""SELECT route, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'password') THEN 'secrets' WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'terms' WHEN length(text) > 400 THEN 'long' ELSE 'other' END AS route
FROM conversations WHERE role = 'user') GROUP BY 1""")
def keyword_routes(t):
    """The first rule that fits decides."""
    low = F.lower("text")
    route = F.when(F.contains(low, F.lit("password")), "secrets").when(low.rlike("licen[sc]e"), "terms").when(F.char_length("text") > 400, "long").otherwise("other")
    return t.conversations.where("role = 'user'").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@plan("""SELECT doc_id, CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END AS gate, n_chars IS NOT NULL AND coalesce(CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END, true) AS eligible FROM documents LEFT JOIN labels USING (doc_id)""")
def tri_state_gate(t):
    """A missing gate lets a row pass; only a false one stops it."""
    d = t.documents.join(t.labels, "doc_id", "left")
    gate = F.col("quality") == 1
    return d.select("doc_id", gate.alias("gate"), (F.col("n_chars").isNotNull() & F.coalesce(gate, F.lit(True))).alias("eligible"))


@plan("""SELECT count(*) AS rows, count(*) FILTER (l_shipdate < o_orderdate) AS late, count(DISTINCT l_orderkey) AS entities, round(sum(w), 6) AS weight FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def as_of_invariants(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("w", W.balanced_weight("l_orderkey"))
    return j.agg(F.count("*").alias("rows"), F.count(F.when(F.col("l_shipdate") < F.col("o_orderdate"), 1)).alias("late"), F.countDistinct("l_orderkey").alias("entities"), r(F.sum("w")).alias("weight"))


@plan("""SELECT window_start AS day, event_type, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS window_start, event_type FROM events) GROUP BY ALL""")
def daily_event_counts(t):
    """The batch form of the streamed counts."""
    return t.events.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))
