"""Paths, scaled rates, targets, ordered reports and promotion decisions on the tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import expr as X
from tidemark.ml import lifecycle as L
from tidemark.operators import paths, splits
from tidemark.operators.tables import stored
from tidemark.operators import windows as W
from tidemark.plans.histories import _H, _W
from tidemark.plans.histories import history as _history
from tidemark.plans.models import _book
from tidemark.plans.registry import plan


def r(x, n: int = 6):
    return F.round(x, n)


@plan("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(50.0::DOUBLE - nullif(l_quantity, 10), 6) AS shortfall,
round(CASE WHEN l_extendedprice > 0 THEN ln(1 + l_extendedprice) END / 10 + greatest(coalesce(nullif(l_tax, 0) * 10, 0), 0) + 0.25 * greatest(l_linenumber - 2, 0) + 0.1 * greatest(coalesce(nullif(l_discount, 0) * 100, 0), 0), 6) AS complexity FROM lineitem""")
def shortfall_complexity(t):
    gone = lambda x, v: F.nullif(x, F.lit(v))
    score = X.complexity("l_extendedprice", gone("l_tax", 0.0) * 10, F.col("l_linenumber") - 2, gone("l_discount", 0.0) * 100)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r(X.progress_shortfall(F.lit(50.0), gone("l_quantity", 10.0))).alias("shortfall"), r(score).alias("complexity"))


@plan("""SELECT conv_id, turn, coalesce(CAST(regexp_matches(text, 'delay|late|overdue|slip', 'i') AS INTEGER), 0) AS late FROM conversations""")
def delay_mentions(t):
    return t.conversations.select("conv_id", "turn", X.mentions_delay("text").alias("late"))


@plan("""SELECT o_orderkey, round(o_totalprice - 250000, 4) AS residual, round(250000 + (o_totalprice - 250000) * 0.5, 4) AS rebuilt,
round(CASE WHEN d > 0 AND o_orderstatus <> 'P' THEN ln(1 + d::DOUBLE) END, 8) AS log_remaining
FROM (SELECT *, CAST(DATE '2001-08-02' - CAST(o_orderdate AS DATE) AS INTEGER) - 1500 AS d FROM orders)""")
def residual_targets(t):
    """What is left to add to a current value, the value rebuilt from half of it, and the log of the days left."""
    day = F.col("o_orderdate").cast("date")
    planned = F.when(F.col("o_orderstatus") != "P", day)
    left = X.remaining_target(F.lit("2001-08-02").cast("date"), F.date_add(day, 1500), planned)
    residual = F.col("o_totalprice") - 250000
    return t.orders.select("o_orderkey", r(residual, 4).alias("residual"), r(250000 + residual * 0.5, 4).alias("rebuilt"), r(left, 8).alias("log_remaining"))


@plan("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER () AS n FROM orders)
SELECT place > n - CAST(floor(n * 0.2) AS BIGINT) AS test, count(*) AS n, min(o_orderkey) AS least_key, max(o_orderkey) AS greatest_key FROM o GROUP BY 1""")
def row_split(t):
    train, test = splits.by_rows(t.orders, ["o_orderdate", "o_orderkey"], 0.2)
    both = train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))
    return both.groupBy("test").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least_key"), F.max("o_orderkey").alias("greatest_key"))


@plan("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def limit_clamped(t):
    """A caller asks for 5,000 rows; a report gives 100 at most."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(X.clamped_limit(5000, 100))


@plan("""WITH s AS (SELECT nullif(o_orderpriority, '3-MEDIUM') AS sector, count(*) AS n, round(avg(abs(o_totalprice - 250000)), 3) AS mae FROM orders GROUP BY 1)
SELECT sector, n, mae, CAST(row_number() OVER (ORDER BY n DESC, sector NULLS LAST) AS INTEGER) AS place FROM s""")
def sector_errors_ordered(t):
    """The group without a name is kept, and comes last among equals."""
    sector = F.nullif("o_orderpriority", F.lit("3-MEDIUM"))
    g = t.orders.groupBy(sector.alias("sector")).agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("o_totalprice") - 250000)), 3).alias("mae"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last("sector"))))  # a row a sector


@plan("""SELECT user_id, round(avg(CASE WHEN event_type NOT IN ('error', 'purchase') THEN value END), 6) AS mean, count(*) AS n FROM events GROUP BY 1""")
def mean_of_finite(t):
    odd = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "purchase", float("inf")).otherwise(F.col("value"))
    return t.events.groupBy("user_id").agg(r(F.avg(X.finite(odd))).alias("mean"), F.count("*").alias("n"))


_SLIP = "CASE WHEN event_type <> 'purchase' THEN CAST(event_id % 11 - 5 AS DOUBLE) END"
_P = f"{_W} ROWS UNBOUNDED PRECEDING"


def _path(t):
    return _history(t).select("user_id", "day", F.col("v").alias("cost"), ((F.col("v") - 50) / 50 * 100).alias("esc"), F.expr(_SLIP).alias("slip"))


@plan(f"""WITH {_H}, p AS (SELECT user_id, day, v AS cost, (v - 50) / 50 * 100 AS esc, {_SLIP} AS slip FROM h),
d AS (SELECT *, lag(cost) OVER ({_W}) AS pc, coalesce(CAST(abs(cost - lag(cost) OVER ({_W})) > 1e-9 AS INTEGER), 0) AS cr, coalesce(CAST(abs(slip - lag(slip) OVER ({_W})) > 1e-9 AS INTEGER), 0) AS sr,
CASE WHEN row_number() OVER ({_W}) > 1 THEN coalesce(CAST(esc - lag(esc) OVER ({_W}) > 0 AS INTEGER), 0) END AS ew, CASE WHEN row_number() OVER ({_W}) > 1 THEN coalesce(CAST(slip - lag(slip) OVER ({_W}) > 0 AS INTEGER), 0) END AS sw FROM p)
SELECT user_id, day, CAST(row_number() OVER ({_W}) AS INTEGER) AS observations_seen, round((day - min(day) OVER ({_P})) / 30.4375, 8) AS months_observed,
CAST(sum(cr) OVER ({_P}) AS BIGINT) AS cost_revision_count, CAST(sum(sr) OVER ({_P}) AS BIGINT) AS schedule_revision_count,
round(sum(coalesce(abs(cost - pc) / nullif(abs(pc), 0) * 100, 0.0)) OVER ({_P}), 4) AS abs_cost_revision_pct,
round(CASE WHEN esc IS NOT NULL THEN max(esc) OVER ({_P}) END, 6) AS max_escalation, round(CASE WHEN esc IS NOT NULL THEN max(esc) OVER ({_P}) END - esc, 6) AS escalation_recovery,
round(CASE WHEN slip IS NOT NULL THEN max(slip) OVER ({_P}) END, 6) AS max_slippage, round(CASE WHEN slip IS NOT NULL THEN max(slip) OVER ({_P}) END - slip, 6) AS slippage_recovery,
round(avg(CAST(slip > 0 AS INTEGER)) OVER ({_P}), 8) AS slippage_positive_share, round(avg(CAST(esc > 0 AS INTEGER)) OVER ({_P}), 8) AS escalation_positive_share,
round(avg(ew) OVER ({_P}), 8) AS escalation_worsening_share, round(avg(sw) OVER ({_P}), 8) AS slippage_worsening_share,
round(coalesce((day - min(CASE WHEN cr = 1 THEN day END) OVER ({_P})) / 30.4375, -1.0), 8) AS months_since_first_cost_revision,
round(coalesce((day - min(CASE WHEN sr = 1 THEN day END) OVER ({_P})) / 30.4375, -1.0), 8) AS months_since_first_schedule_revision FROM d""")
def full_path(t):
    """All features of a path; slippage is an invented number of the event."""
    found = paths.path_features(_path(t), "user_id", "cost", "esc", "slip")
    digits = {"abs_cost_revision_pct": 4, "max_escalation": 6, "escalation_recovery": 6, "max_slippage": 6, "slippage_recovery": 6}
    whole = ("observations_seen", "cost_revision_count", "schedule_revision_count")
    return found.select("user_id", "day", *(F.col(c) if c in whole else r(c, digits.get(c, 8)).alias(c) for c in paths.PATH))


def _rate_sql(x: str, n: int) -> str:
    w = f"{_W} RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING"
    return f"({x} - first_value({x} IGNORE NULLS) OVER ({w})) / ((day - first_value(CASE WHEN {x} IS NOT NULL THEN day END IGNORE NULLS) OVER ({w})) / 30.4375)"


def _rates_sql() -> str:
    columns, islands = [], []
    for x in ("cost_pct", "spend_pct", "slip_pct"):
        columns += [f"round({_rate_sql(x, n)}, 6) AS {x}_rate_{label}" for label, n in (("short", 3), ("middle", 7), ("long", 14))]
        columns.append(f"round({_rate_sql(x, 3)} - {_rate_sql(x, 7)}, 6) AS {x}_acceleration")
    for x in ("cost_pct", "slip_pct"):
        moved = f"{x} - lag({x}) OVER ({_W})"
        islands.append(f"{moved} AS d_{x}")
        columns.append(f"round(sum(abs(d_{x})) OVER ({_W} RANGE BETWEEN 14 PRECEDING AND CURRENT ROW), 4) AS {x}_revised_by")
        columns.append(f"CAST(sum(CASE WHEN d_{x} > 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, i_{x} ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {x}_streak")
    numbers = ", ".join(f"sum(CASE WHEN d_{x} <= 1e-9 THEN 1 ELSE 0 END) OVER ({_P}) AS i_{x}" for x in ("cost_pct", "slip_pct"))
    return f"""WITH {_H}, p AS (SELECT user_id, day, v, {_SLIP} AS slip, CASE WHEN user_id % 7 > 0 THEN 40.0::DOUBLE + user_id % 7 END AS approved, 20.0::DOUBLE + user_id % 5 AS planned FROM h),
s AS (SELECT *, (v - approved) / approved * 100 AS cost_pct, v / approved * 100 AS spend_pct, slip / planned * 100 AS slip_pct FROM p), d AS (SELECT *, {", ".join(islands)} FROM s), i AS (SELECT *, {numbers} FROM d)
SELECT user_id, day, {", ".join(columns)}, round(spend_pct - 50, 6) AS spend_ahead FROM i"""


@plan(_rates_sql())
def scaled_rates(t):
    h = _history(t).select("user_id", "day", "v", F.expr(_SLIP).alias("slip"), F.when(F.col("user_id") % 7 > 0, 40.0 + F.col("user_id") % 7).alias("approved"), (20.0 + F.col("user_id") % 5).alias("planned"), F.lit(50.0).alias("expected"))
    found = paths.scaled_rates(h, "user_id", "approved", "v", "v", "slip", "planned", "expected", widths=(3, 7, 14))
    rates = [f"{x}_{k}" for x in ("cost_pct", "spend_pct", "slip_pct") for k in ("rate_short", "rate_middle", "rate_long", "acceleration")]
    moved = [f"{x}_revised_by" for x in ("cost_pct", "slip_pct")]
    return found.select("user_id", "day", *(r(c).alias(c) for c in (*rates, "spend_ahead")), *(r(c, 4).alias(c) for c in moved), "cost_pct_streak", "slip_pct_streak")


@plan("""SELECT count(*) AS rows, count(DISTINCT o_custkey) AS entities, count(nxt) AS schedule_labels, count(delta) AS cost_labels, least(count(nxt), count(delta)) >= 30 AND count(DISTINCT o_custkey) >= 10 AS sufficient
FROM (SELECT *, lead(o_orderdate) OVER w AS nxt, CASE WHEN o_orderstatus <> 'P' THEN lead(o_totalprice) OVER w - o_totalprice END AS delta FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def archive_sufficiency(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    delta = F.when(F.col("o_orderstatus") != "P", F.lead("o_totalprice").over(w) - F.col("o_totalprice"))
    rows = t.orders.select("o_custkey", F.lead("o_orderdate").over(w).alias("nxt"), delta.alias("delta"))
    return L.archive_status(rows, "o_custkey", "nxt", "delta")


@plan("""WITH e AS (SELECT o_orderpriority AS stage, abs(250000 - o_totalprice) AS b, abs(o_totalprice * 0.9 - o_totalprice) AS c FROM orders), s AS (SELECT stage, avg(c) > avg(b) AS worse FROM e GROUP BY 1)
SELECT round((avg(b) - avg(c)) / avg(b) * 100, 6) AS gain, (SELECT count(*) FROM s WHERE worse) AS worse_stages, (avg(b) - avg(c)) / avg(b) * 100 >= 10 AND (SELECT count(*) FROM s WHERE worse) = 0 AS promote FROM e""")
def promotion(t):
    return L.promotion(_book(t)).select(r("gain").alias("gain"), "worse_stages", "promote")


_Y = "y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_totalprice AS v FROM orders)"


@plan(f"""WITH {_Y}, s AS (SELECT yr, sum(v) AS total, count(*) AS n FROM y GROUP BY 1), b AS (SELECT yr, sum(total) OVER w / sum(n) OVER w AS prior FROM s WINDOW w AS (ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT yr, round(avg(abs(v - prior)), 3) AS mae, count(*) AS n FROM y JOIN b USING (yr) WHERE prior IS NOT NULL GROUP BY 1""")
def expanding_baseline(t):
    """Each year predicted by the mean of the years before: what a model of a rolling fold has to beat."""
    rows = t.orders.select(F.year("o_orderdate").alias("yr"), F.col("o_totalprice").alias("v"))
    return L.expanding_baseline(rows, "yr", "v").select("yr", r("mae", 3).alias("mae"), "n")


def _training(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("entity"), "l_quantity", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), "l_discount", "l_returnflag", F.col("o_orderpriority").alias("sector"),
        F.col("l_linestatus").alias("stage"), F.year("l_shipdate").alias("yr"), F.col("l_extendedprice").alias("y"),
    ).withColumn("w", W.balanced_weight("entity"))
    return stored(rows, "training")  # read by every fit and every score


_FEATURES = L.Features(("l_quantity", "l_tax", "l_discount"), ("l_returnflag",))


@plan()
def rolling_validation(t):
    found = L.rolling_validation(_training(t), _FEATURES, "y", "w", "yr", "entity")
    return found.select("fold", "rows", r("mae", 2).alias("mae"), r("r2", 4).alias("r2"))


@plan()
def stage_specialists(t):
    found = L.stage_specialists(_training(t), _FEATURES, "y", "w", "yr", "entity", "stage")
    return found.select("stage", "train_entities", "test_entities", r("mae", 2).alias("mae"), r("global_mae", 2).alias("global_mae"))


@plan()
def sector_correction(t):
    found = L.sector_correction(_training(t), _FEATURES, "y", "w", "yr", "sector")
    return found.select("correction_year", "validation_year", r("mae", 2).alias("mae"), r("corrected_mae", 2).alias("corrected_mae"), "enabled")


@plan()
def group_selection(t):
    found = L.group_selection(_training(t), _FEATURES, "y", "w", "yr", {"terms": ("l_tax", "l_discount"), "flags": ("l_returnflag",)})
    return found.select("variant", r("mae", 2).alias("mae"), "chosen")


@plan()
def residual_against_direct(t):
    """The price as 1,000 a unit plus a residual, against the price itself; straight, by signed log and with Huber's loss."""
    rows = _training(t).withColumn("current", F.col("l_quantity") * 1000)
    return L.targets_compared(rows, _FEATURES, "y", "current", "w", "yr").select("target", r("mae", 2).alias("mae"), "rows")


_SOLD = "t AS (SELECT l_orderkey AS entity, l_linestatus AS stage, o_orderpriority AS sector, CAST(year(l_shipdate) AS INTEGER) AS yr, l_extendedprice AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey), z AS (SELECT max(yr) AS last FROM t)"


@plan(f"""WITH {_SOLD} SELECT stage, count(DISTINCT entity) FILTER (yr < last) AS train_entities, count(DISTINCT entity) FILTER (yr = last) AS test_entities FROM t, z GROUP BY 1""")
def specialist_entities(t):
    """How many entities a specialist of each stage would learn from and be tested on."""
    return L.entities_by_stage(_training(t), "yr", "entity", "stage")


@plan(f"""WITH {_SOLD}, p AS (SELECT avg(y) AS mean FROM t, z WHERE yr < last - 1), c AS (SELECT sector, avg(y - mean) * count(*) / (count(*) + 5) AS correction FROM t, z, p WHERE yr = last - 1 GROUP BY 1)
SELECT sector, count(*) AS rows, round(any_value(correction), 4) AS correction, round(avg(abs(y - mean)), 4) AS mae, round(avg(abs(y - mean - correction)), 4) AS corrected_mae FROM t JOIN c USING (sector), z, p WHERE yr = last GROUP BY 1""")
def mean_corrections(t):
    """Corrections of a sector learned on the last year but one, over the mean of the years before, and checked on the last."""
    rows = _training(t)
    last = rows.agg(F.max("yr")).first()[0]
    mean = rows.where(F.col("yr") < last - 1).agg(F.avg("y")).first()[0]
    said = rows.withColumn("prediction", F.lit(mean))
    table = L.corrections(said.where(F.col("yr") == last - 1), "sector", F.col("y") - F.col("prediction"))
    checked = L.corrected(said.where(F.col("yr") == last).withColumn("plain", F.col("prediction")), table, "sector")
    errors = checked.groupBy("sector").agg(F.count("*").alias("rows"), F.max(F.col("prediction") - F.col("plain")).alias("correction"), F.avg(F.abs(F.col("y") - F.col("plain"))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("corrected_mae"))
    return errors.select("sector", "rows", *(r(c, 4).alias(c) for c in ("correction", "mae", "corrected_mae")))
