"""Scans, filters and row-wise derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.plans.registry import plan


def r(x, n: int = 6):
    return F.round(x, n)


@plan("""SELECT l_orderkey, l_quantity, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""")
def scan_prune_filter(t):
    days = F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    return t.lineitem.where(days).select("l_orderkey", "l_quantity", F.col("l_shipdate").cast("date").alias("ship_date"))


@plan("""SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'brand#17') ORDER BY p_partkey""")
def search_multi_column(t):
    """Literal by default, so that signs in a search mean themselves."""
    found = F.contains(F.lower("p_name"), F.lit("ring")) | F.contains(F.lower("p_brand"), F.lit("brand#17"))
    return t.part.where(F.coalesce(found, F.lit(False))).select("p_partkey", "p_name", "p_brand")


@plan("""SELECT p_partkey, p_name FROM part WHERE coalesce(regexp_matches(lower(p_name), '^(red|blue).*g'), false)""")
def search_pattern(t):
    return t.part.where(F.coalesce(F.lower("p_name").rlike("^(red|blue).*g"), F.lit(False))).select("p_partkey", "p_name")


@plan("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77""")
def point_lookup(t):
    return t.customer.where("c_custkey = 77").select("c_custkey", "c_name", "c_acctbal").limit(1)


@plan("""SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations WHERE conv_id = 7 AND turn = 1""")
def composite_lookup(t):
    """A turn by conversation and number: both parts reach the scan."""
    return t.conversations.where(X.keyed({"conv_id": 7, "turn": 1})).select("conv_id", "turn", "role", F.md5("text").alias("text_md5")).limit(1)


@plan("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL AND nullif(l_tax, 0) IS NOT NULL AND nullif(l_quantity, 10) IS NOT NULL""")
def all_known(t):
    """Lines of which a whole set of columns is known."""
    gone = {"l_discount": 0.0, "l_tax": 0.0, "l_quantity": 10.0}
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *(F.nullif(c, F.lit(v)).alias(c) for c, v in gone.items()))
    return rows.where(X.all_known(gone)).select("l_orderkey", "l_linenumber")


@plan("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
round(CASE WHEN l_extendedprice > 0 THEN (l_extendedprice * (1 - l_discount) - l_extendedprice) / l_extendedprice * 100 END, 4) AS change_pct,
round(CASE WHEN l_tax > 0 THEN l_discount / l_tax END, 6) AS discount_to_tax,
round(CASE WHEN nullif(l_discount, 0) IS NULL THEN NULL ELSE least(1.0, greatest(0.0, l_discount * 12)) END, 6) AS clamped
FROM lineitem""")
def pct_change_guarded(t):
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        r(X.pct_change("l_extendedprice", paid), 4).alias("change_pct"),
        r(X.ratio("l_discount", "l_tax")).alias("discount_to_tax"),
        r(X.clamp(F.nullif("l_discount", F.lit(0.0)) * 12, 0.0, 1.0)).alias("clamped"),
    )


@plan("""SELECT o_orderkey,
CASE WHEN x <= 500 THEN 'small' WHEN x <= 2000 THEN 'medium' WHEN x <= 10000 THEN 'large' ELSE 'mega' END AS size4,
CASE WHEN x <= 500 THEN 'Small' WHEN x <= 5000 THEN 'Medium' ELSE 'Large' END AS size3
FROM (SELECT o_orderkey, o_totalprice / 40 AS x FROM orders)""")
def size_bins(t):
    x = F.col("o_totalprice") / 40
    return t.orders.select("o_orderkey", X.band(x, X.SIZE4).alias("size4"), X.band(x, X.SIZE3).alias("size3"))


@plan("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
CASE WHEN l_quantity / 50 <= 0.3 THEN 'early' WHEN l_quantity / 50 <= 0.6 THEN 'mid' WHEN l_quantity / 50 <= 0.9 THEN 'late' ELSE 'very_late' END AS stage
FROM lineitem""")
def stage_bins(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", X.band(F.col("l_quantity") / 50, X.STAGES).alias("stage"))


_LAG = """SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber,
CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS d FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""


def _lag(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


@plan(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, d AS signed_days, greatest(0, d) AS delay,
CASE WHEN greatest(0, d) < 90 THEN 'LOW' WHEN greatest(0, d) < 365 THEN 'MEDIUM' WHEN greatest(0, d) < 730 THEN 'HIGH' ELSE 'CRITICAL' END AS risk,
CASE WHEN d < 90 THEN 0 WHEN d < 365 THEN 1 WHEN d < 730 THEN 2 ELSE 3 END AS risk_code FROM ({_LAG})""")
def ship_lag_risk(t):
    d = X.days("l_shipdate", "o_orderdate")
    late = X.delay_days("l_shipdate", "o_orderdate")
    return _lag(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", d.alias("signed_days"), late.alias("delay"), X.risk_label(late).alias("risk"), X.risk_code(d).alias("risk_code"))


@plan("""SELECT o_orderkey, CAST(year(d) AS INTEGER) AS y, CAST(quarter(d) AS INTEGER) AS q, year(d) || 'Q' || quarter(d) AS quarter_label,
year(d - INTERVAL 3 MONTH) || '-' || lpad(CAST((year(d - INTERVAL 3 MONTH) + 1) % 100 AS VARCHAR), 2, '0') AS fiscal_year,
last_day(d) AS month_end,
CAST(nullif(greatest(0, (1999 - year(d)) * 12 + 6 - month(d)), 0) AS INTEGER) AS months_to_june_1999
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def calendar_arithmetic(t):
    d = F.col("o_orderdate").cast("date")
    fy = X.fiscal_year(d)
    return t.orders.select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), X.quarter_label(d).alias("quarter_label"), fy.alias("fiscal_year"),
        X.fiscal_month_end(fy, F.month(d)).alias("month_end"), X.month_gap(F.lit("1999-06-15").cast("date"), d).alias("months_to_june_1999"),
    )


@plan("""SELECT p_partkey, nullif(trim(regexp_replace(lower(p_name || ' - ' || p_brand), '[^a-z0-9]+', ' ', 'g')), '') AS name_key,
coalesce(CASE WHEN p_size > 25 THEN p_brand END, 'legacy:' || substring(sha1(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || '|' ||
trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g'))), 1, 16)) AS entity_key FROM part""")
def name_keys(t):
    own = F.when(F.col("p_size") > 25, F.col("p_brand"))
    return t.part.select("p_partkey", X.name_key(F.concat_ws(" - ", "p_name", "p_brand")).alias("name_key"), X.fallback_key(own, "p_name", "p_type").alias("entity_key"))


@plan("""SELECT event_id, round(CASE WHEN value > 0 THEN ln(1 + value) END, 6) AS log_value, round(sign(z) * ln(1 + abs(z)), 6) AS signed_log,
round(sign(z) * (exp(ln(1 + abs(z))) - 1), 6) AS back, round(exp(least(20.0, greatest(-20.0, z))) - 1, 3) AS clipped
FROM (SELECT event_id, value, (value - 50) / 10 AS z FROM events)""")
def log_transforms(t):
    z = (F.col("value") - 50) / 10
    return t.events.select(
        "event_id", r(X.log1p_positive("value")).alias("log_value"), r(X.signed_log(z)).alias("signed_log"),
        r(X.signed_exp(X.signed_log(z))).alias("back"), r(X.expm1_clipped(z), 3).alias("clipped"),
    )


@plan("""SELECT event_id, round(ln(1 + value + shift), 6) AS shifted FROM events,
(SELECT greatest(0.0, 1 - min(value)) AS shift FROM events)""")
def shifted_log(t):
    shift = t.events.agg(F.greatest(F.lit(0.0), 1 - F.min("value")).alias("shift"))
    return t.events.join(F.broadcast(shift)).select("event_id", r(F.log1p(F.col("value") + F.col("shift"))).alias("shifted"))  # one row


@plan("""SELECT event_id, k, CASE WHEN k IS NULL THEN NULL WHEN k >= 90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS high, k IS NOT NULL AS has_k,
CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS from_pattern
FROM (SELECT event_id, props, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def json_fields(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    high = F.when(k.isNotNull(), (k >= 90).cast("double"))
    return t.events.select("event_id", k.alias("k"), high.alias("high"), k.isNotNull().alias("has_k"), F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("from_pattern"))


@plan("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'ring|chain') THEN 'Jewellery' WHEN regexp_matches(lower(p_name), 'widget') THEN 'Tools'
WHEN regexp_matches(lower(p_name), 'bolt|nut') THEN 'Fasteners' ELSE 'Other' END AS bucket FROM part""")
def pattern_buckets(t):
    rules = (("ring|chain", "Jewellery"), ("widget", "Tools"), ("bolt|nut", "Fasteners"))
    return t.part.select("p_partkey", X.bucket_by_pattern("p_name", rules).alias("bucket"))


@plan("""SELECT e.event_id, round(CASE WHEN b <> 0 THEN (b - v) / b * 100 WHEN v = 0 THEN 0.0 END, 4) AS improvement,
round(greatest(0.0, least(100.0, 100 - abs(v - b) / CASE WHEN abs(b) < 1 THEN 1.0 ELSE abs(b) END * 100)), 4) AS accuracy,
round(greatest(0.0, b + least(5.0, greatest(-5.0, v - b))), 6) AS bounded, round(0.6 * b + 0.4 * v, 6) AS blended
FROM (SELECT event_id, value AS v, floor(value / 10) * 10 AS b FROM events) e""")
def prediction_arithmetic(t):
    e = t.events.select("event_id", F.col("value").alias("v"), (F.floor(F.col("value") / 10) * 10).cast("double").alias("b"))
    return e.select(
        "event_id", r(X.improvement_pct("b", "v"), 4).alias("improvement"), r(X.accuracy_pct("v", "b"), 4).alias("accuracy"),
        r(X.bounded_correction("b", F.col("v") - F.col("b"), F.lit(5.0))).alias("bounded"), r(X.blend((("b", 0.6), ("v", 0.4)))).alias("blended"),
    )


@plan("""SELECT event_id, round(q[1], 6) AS p10, round(q[2], 6) AS p50, round(q[3], 6) AS p90, round(q[2] - (q[2] - q[1]) * 1.5, 6) AS wide_low, round(q[2] + (q[3] - q[2]) * 1.5, 6) AS wide_high
FROM (SELECT event_id, list_sort([value, value * 1.2 - 5, 60.0 - value / 3]) AS q FROM events)""")
def quantile_repair(t):
    e = t.events.select("event_id", X.repaired_quantiles("value", F.col("value") * 1.2 - 5, 60.0 - F.col("value") / 3).alias("q"))
    w = X.widened(F.col("q")[0], F.col("q")[1], F.col("q")[2], 1.5)
    return e.select("event_id", *(r(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p50", "p90"))), r(w["low"]).alias("wide_low"), r(w["high"]).alias("wide_high"))


@plan(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(greatest(0.0, 37.5 + d) AS DOUBLE) AS late_if_remaining FROM ({_LAG})""")
def remaining_days_to_delay(t):
    return _lag(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r(X.late_from_remaining(F.lit(37.5), "l_shipdate", "o_orderdate"), 4).alias("late_if_remaining"))


@plan("""SELECT doc_id, quality IS NOT NULL AS labelled, (CAST(quality IS NOT NULL AS INTEGER) + CAST(toxic IS NOT NULL AS INTEGER) + 1) / 3.0::DOUBLE AS completeness,
coalesce(CAST(n_chars > 2000 AS INTEGER), 0) AS long_flag, coalesce(CAST(quality = 0 AS INTEGER), 0) AS poor_flag,
CASE WHEN quality IS NULL THEN NULL ELSE quality * 1.0::DOUBLE END AS kept_null
FROM documents LEFT JOIN labels USING (doc_id)""")
def null_keeping_flags(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    flag = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    return d.select(
        "doc_id", F.col("quality").isNotNull().alias("labelled"), X.completeness("quality", "toxic", "doc_id").alias("completeness"),
        flag(F.col("n_chars") > 2000).alias("long_flag"), flag(F.col("quality") == 0).alias("poor_flag"), F.col("quality").cast("double").alias("kept_null"),
    )


@plan("""SELECT c_custkey, 'x' AS absent_a, CAST(NULL AS DOUBLE) AS absent_b, c_acctbal FROM (SELECT c_custkey, c_acctbal FROM customer)""")
def contract_projection(t):
    from tidemark.sources.schemas import fit_contract

    return fit_contract(t.customer, {"c_custkey": "bigint", "absent_a": "string", "absent_b": "double", "c_acctbal": "double"}, {"absent_a": F.lit("x")})
