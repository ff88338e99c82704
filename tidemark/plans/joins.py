"""Join plans: identity, strictly earlier priors, fallback, peers, gaps, overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import windows as W
from tidemark.plans.registry import plan


def r(x, n: int = 6):
    return F.round(x, n)


# As SQL has them: doubles stay doubles, so that -0.0 keeps its sign, and with it its own key. Spark's floor goes through
# long and its round through decimal, which have no such zero.
def _floor(x):
    return F.when(F.rint(x) > x, F.rint(x) - 1).otherwise(F.rint(x))


def _whole(x):
    """The nearest whole number, halves away from zero."""
    return F.when(F.abs(x - F.rint(x)) == 0.5, x + F.signum(x) * 0.5).otherwise(F.rint(x))


# Outcomes: customers under an id that most orders know, and a name made of segment and nation that only some hold alone.
_OUT = """out AS (SELECT CASE WHEN c_acctbal > 0 THEN CAST(c_custkey AS VARCHAR) END AS outcome_id, lower(c_mktsegment) || ' ' || floor(c_acctbal / 10) AS outcome_key,
round(c_acctbal, 1) AS outcome_amount FROM customer)"""
_ROWS = """rows_ AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS entity_id, lower(c_mktsegment) || ' ' || floor(c_acctbal / 10) AS name_key, c_acctbal AS amount
FROM orders JOIN customer ON o_custkey = c_custkey)"""


@plan(f"""WITH {_OUT}, {_ROWS}, ui AS (SELECT * FROM out WHERE outcome_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY outcome_id) = 1),
un AS (SELECT * FROM out WHERE outcome_key IS NOT NULL QUALIFY count(*) OVER (PARTITION BY outcome_key) = 1), nn AS (SELECT outcome_key AS k, count(*) AS n FROM out GROUP BY 1),
m AS (SELECT r.*, ui.outcome_id AS i, un.outcome_key AS nk, un.outcome_amount AS na, ui.outcome_amount AS ia, nn.n FROM rows_ r LEFT JOIN ui ON r.entity_id = ui.outcome_id
LEFT JOIN un ON r.name_key = un.outcome_key LEFT JOIN nn ON r.name_key = nn.k)
SELECT o_orderkey, CASE WHEN i IS NOT NULL THEN 'exact_id' WHEN nk IS NOT NULL AND abs(amount - na) <= 0.05 THEN 'exact_name_and_amount' WHEN nk IS NOT NULL THEN 'name_amount_mismatch'
WHEN n > 1 THEN 'ambiguous_name' ELSE 'unresolved' END AS method, CASE WHEN i IS NOT NULL THEN 1.0::DOUBLE WHEN nk IS NOT NULL AND abs(amount - na) <= 0.05 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
i IS NOT NULL OR coalesce(nk IS NOT NULL AND abs(amount - na) <= 0.05, false) AS verified,
CASE WHEN i IS NOT NULL THEN ia WHEN nk IS NOT NULL AND abs(amount - na) <= 0.05 THEN na END AS outcome_amount FROM m""")
def identity_resolve(t):
    key = F.concat(F.lower("c_mktsegment"), F.lit(" "), _floor(F.col("c_acctbal") / 10).cast("string"))
    amount = (_whole(F.col("c_acctbal") * 10) / 10).alias("outcome_amount")
    out = t.customer.select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).alias("outcome_id"), key.alias("outcome_key"), amount)
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("entity_id"), key.alias("name_key"), F.col("c_acctbal").alias("amount")
    )
    return J.resolve_identity(rows, out).select("o_orderkey", "method", "confidence", "verified", "outcome_amount")


@plan("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_brand, round(l_quantity * p_retailprice, 2) AS listed FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def many_to_one_join(t):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    return J.many_to_one(t.lineitem, part, ["l_partkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p_brand", r(F.col("l_quantity") * F.col("p_retailprice"), 2).alias("listed"))


_DAY = "CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER)"
_O = f"o AS (SELECT o_orderkey, o_custkey, o_orderpriority, c_nationkey, o_totalprice, {_DAY} AS day, CAST(o_totalprice > 250000 AS INTEGER) AS big FROM orders JOIN customer ON o_custkey = c_custkey)"


def _orders(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "o_orderpriority", "c_nationkey", "o_totalprice", W.day_number("o_orderdate").alias("day"), (F.col("o_totalprice") > 250000).cast("int").alias("big")
    )


def _prior_sql(name: str, by: str) -> str:
    p = f"PARTITION BY {by} " if by else ""
    w = f"OVER ({p}ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"count(*) {w} AS {name}_n, avg(o_totalprice) {w} AS {name}_mean, avg(big) {w} AS {name}_rate"


@plan(f"""WITH {_O}, p AS (SELECT *, {_prior_sql('overall', '')}, {_prior_sql('grp', 'o_orderpriority')}, {_prior_sql('fine', 'o_orderpriority, c_nationkey')} FROM o)
SELECT o_orderkey, overall_n, grp_n, fine_n, round(overall_mean * overall_n, 2) AS overall_sum, round(overall_rate * overall_n, 2) AS overall_hits, round(grp_mean * grp_n, 2) AS group_sum,
round(CASE WHEN fine_n >= 3 THEN fine_mean * fine_n WHEN grp_n >= 3 THEN grp_mean * grp_n ELSE overall_mean * overall_n END, 2) AS sum_with_fallback,
round(CASE WHEN fine_n >= 3 THEN fine_rate * fine_n WHEN grp_n >= 3 THEN grp_rate * grp_n ELSE overall_rate * overall_n END, 2) AS hits_with_fallback FROM p""")
def asof_priors(t):
    o = _orders(t)
    m = {"mean": F.col("o_totalprice"), "rate": F.col("big")}
    out = J.earlier_stats(o, o, "day", m, (), "overall")
    out = J.earlier_stats(out, o, "day", m, ("o_orderpriority",), "grp")
    out = J.earlier_stats(out, o, "day", m, ("o_orderpriority", "c_nationkey"), "fine")
    levels = ["fine", "grp", "overall"]
    n = F.when(F.col("fine_n") >= 3, F.col("fine_n")).when(F.col("grp_n") >= 3, F.col("grp_n")).otherwise(F.col("overall_n"))
    # Sums, not means: means of cents can end in a five that two engines round apart.
    return out.select(
        "o_orderkey", "overall_n", "grp_n", "fine_n", r(F.col("overall_mean") * F.col("overall_n"), 2).alias("overall_sum"), r(F.col("overall_rate") * F.col("overall_n"), 2).alias("overall_hits"),
        r(F.col("grp_mean") * F.col("grp_n"), 2).alias("group_sum"), r(J.with_fallback(out, levels, "mean") * n, 2).alias("sum_with_fallback"), r(J.with_fallback(out, levels, "rate") * n, 2).alias("hits_with_fallback"),
    )


@plan(f"""WITH {_O}, q AS (SELECT *, day + CAST(o_orderkey % 40 AS INTEGER) - 10 AS cutoff FROM o),
g AS (SELECT o_orderpriority, day, count(*) AS n, sum(o_totalprice) AS s FROM o GROUP BY 1, 2), a AS (SELECT day, count(*) AS n, sum(o_totalprice) AS s FROM o GROUP BY 1),
gs AS (SELECT q.o_orderkey, coalesce(sum(g.n), 0) AS n, coalesce(sum(g.s), 0) AS s FROM q LEFT JOIN g ON g.o_orderpriority = q.o_orderpriority AND g.day < q.cutoff GROUP BY 1),
sa AS (SELECT q.o_orderkey, coalesce(sum(a.n), 0) AS n, coalesce(sum(a.s), 0) AS s FROM q LEFT JOIN a ON a.day < q.cutoff GROUP BY 1)
SELECT q.o_orderkey, round(CASE WHEN gs.n - m > 0 THEN (gs.s - m * o_totalprice + 5 * ((sa.s - m * o_totalprice) / nullif(sa.n - m, 0))) / (gs.n - m + 5) END, 3) AS prior
FROM (SELECT *, CAST(day < cutoff AS INTEGER) AS m FROM q) q JOIN gs USING (o_orderkey) JOIN sa USING (o_orderkey)""")
def leave_one_out_prior(t):
    o = _orders(t).withColumn("cutoff", F.col("day") + F.pmod("o_orderkey", F.lit(40)).cast("int") - 10)
    return J.leave_one_out(o, "o_totalprice", "o_orderpriority", "cutoff", "day").select("o_orderkey", r("prior", 3).alias("prior"))


@plan("""WITH o AS (SELECT o_orderkey, o_totalprice AS y, c_mktsegment AS a, c_nationkey AS b, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey), f AS (SELECT * FROM o WHERE o_orderstatus = 'F' AND b < 20),
g AS (SELECT avg(y) AS g FROM f), ab AS (SELECT a, b, (sum(y) + 20 * any_value(g)) / (count(*) + 20) AS v, count(*) AS n FROM f, g GROUP BY a, b),
aa AS (SELECT a, (sum(y) + 20 * any_value(g)) / (count(*) + 20) AS v, count(*) AS n FROM f, g GROUP BY a)
SELECT o_orderkey, round(coalesce(ab.v, aa.v, g.g), 4) AS prior, coalesce(ab.n, aa.n, 0) AS support FROM o LEFT JOIN ab USING (a, b) LEFT JOIN aa USING (a) CROSS JOIN g""")
def hierarchical_fallback(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b"), "o_orderstatus")
    facts = o.where("o_orderstatus = 'F' AND b < 20").select("y", "a", "b")
    return J.hierarchical(o, facts, "y", [["a", "b"], ["a"]]).select("o_orderkey", r("prior", 4).alias("prior"), "support")


@plan("""WITH o AS (SELECT o_orderkey, o_orderpriority AS g, o_totalprice AS y, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders),
ys AS (SELECT g, yr, sum(y) AS s, count(*) AS n FROM o GROUP BY 1, 2), ya AS (SELECT yr, sum(y) AS s, count(*) AS n FROM o GROUP BY 1),
pg AS (SELECT k.g, k.yr, coalesce(sum(e.s), 0) AS s, coalesce(sum(e.n), 0) AS n FROM ys k LEFT JOIN ys e ON e.g = k.g AND e.yr < k.yr GROUP BY 1, 2),
pa AS (SELECT k.yr, sum(e.s) / sum(e.n) AS a FROM ya k LEFT JOIN ya e ON e.yr < k.yr GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN n > 0 THEN (s + 20 * a) / (n + 20) ELSE 0.0 END, 4) AS prior, CAST(n AS BIGINT) AS support FROM o JOIN pg USING (g, yr) JOIN pa USING (yr)""")
def earlier_year_prior(t):
    o = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("y"), F.year("o_orderdate").alias("yr"))
    out = J.earlier_stats(o, o, "yr", {"mean": F.col("y")}, ("g",), "grp")
    out = J.earlier_stats(out, o, "yr", {"mean": F.col("y")}, (), "overall")
    prior = (F.col("grp_n") * F.col("grp_mean") + 20 * F.col("overall_mean")) / (F.col("grp_n") + 20)
    return out.select("o_orderkey", r(F.when(F.col("grp_n") > 0, prior).otherwise(0.0), 4).alias("prior"), F.col("grp_n").alias("support"))


@plan("""WITH s AS (SELECT p_type, count(*) AS size FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1), f AS (SELECT part.*, size FROM part LEFT JOIN s USING (p_type) WHERE p_retailprice IS NOT NULL),
x AS (SELECT f.p_partkey AS focus_id, p.p_partkey, p.p_retailprice, abs(ln(1 + p.p_retailprice) - ln(1 + f.p_retailprice)) AS gap FROM f JOIN part p ON p.p_type = f.p_type AND p.p_partkey <> f.p_partkey WHERE f.size > 1
UNION ALL SELECT f.p_partkey, p.p_partkey, p.p_retailprice, abs(ln(1 + p.p_retailprice) - ln(1 + f.p_retailprice)) FROM f JOIN part p ON p.p_partkey <> f.p_partkey WHERE coalesce(f.size, 1) <= 1 AND p.p_retailprice IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY focus_id ORDER BY round(gap, 9), p_partkey) AS place FROM x)
SELECT focus_id, count(*) AS peers, round(median(p_retailprice), 4) AS median_price, max(place) AS last_place FROM n WHERE place <= 5 GROUP BY focus_id ORDER BY median_price DESC, focus_id""")
def peer_benchmark(t):
    """The five parts of the same type nearest in log price to each part, of all types if it is alone in its own, and their
    median price."""
    p = t.part
    near = J.peers(p, p, "p_type", "p_partkey", "p_retailprice", 5)
    out = near.groupBy("focus_id").agg(F.count("*").alias("peers"), r(F.median("p_retailprice"), 4).alias("median_price"), F.max("place").cast("long").alias("last_place"))
    return out.orderBy(F.col("median_price").desc(), "focus_id")


@plan("""SELECT p, m FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)
EXCEPT SELECT DISTINCT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders WHERE o_totalprice > 480000""")
def coverage_gap(t):
    o = t.orders.select(F.col("o_orderpriority").alias("p"), F.trunc("o_orderdate", "month").alias("m"), "o_totalprice")
    bounds = o.agg(F.min("m").alias("a"), F.max("m").alias("b")).first()
    months = F.sequence(F.lit(bounds["a"]), F.lit(bounds["b"]), F.expr("interval 1 month"))  # a few hundred
    spine = o.select("p").distinct().select("p", F.explode(months).alias("m"))
    return J.coverage_gap(spine, o.where("o_totalprice > 480000"), ["p", "m"]).select("p", "m")


@plan("""WITH l AS (SELECT user_id, event_type AS latest_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, latest_type) AS resolved FROM events LEFT JOIN l USING (user_id)""")
def override_coalesce(t):
    last = W.latest(t.events, "user_id", "ts", "event_id").select("user_id", F.col("event_type").alias("resolved"))
    rows = t.events.select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("resolved"))
    return J.overridden(rows, last, "user_id", ["resolved"]).select("event_id", "resolved")


@plan("""SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) <= 1997 INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) >= 2001""")
def leak_check(t):
    y = F.year("o_orderdate")
    return J.overlap(t.orders.where(y <= 1997), t.orders.where(y >= 2001), "o_custkey")


@plan("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_keys(t):
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(keys, "o_custkey", "left_semi").select("o_orderkey")


@plan("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000)""")
def anti_new(t):
    seen = t.orders.where(F.year("o_orderdate") == 2000).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(seen, "c_custkey", "left_anti").select("c_custkey")


@plan("""SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b, a.k IS NOT NULL AND b.k IS NOT NULL AND a.n = b.n AS same
FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k""")
def ledger_composition(t):
    n = lambda s, c: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias(c))
    both = n("F", "n_a").join(n("O", "n_b"), "k", "full")
    return both.withColumn("same", F.coalesce(F.col("n_a") == F.col("n_b"), F.lit(False)))


@plan("""SELECT p_brand FROM part WHERE p_size > 45 EXCEPT SELECT p_brand FROM part WHERE p_retailprice > 1080 AND p_size > 45""")
def set_except(t):
    p = t.part.where("p_size > 45")
    return p.select("p_brand").distinct().join(p.where("p_retailprice > 1080").select("p_brand"), "p_brand", "left_anti")


@plan("""SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2""")
def union_by_name(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("customer"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("supplier"))
    return a.unionByName(b).select("kind", "nation", "n")


@plan("""SELECT DISTINCT p_type FROM part ORDER BY p_type""")
def sorted_distinct(t):
    return t.part.where("p_type IS NOT NULL").select("p_type").distinct().orderBy("p_type")


@plan("""SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def dimension_join(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "n")
