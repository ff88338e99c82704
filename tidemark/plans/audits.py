"""Audit plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audits as D
from tidemark.plans.registry import plan


@plan("""SELECT count(*) AS rows, count(*) FILTER (l_shipdate < o_orderdate) AS shipped_before_order, count(*) FILTER (l_extendedprice > o_totalprice) AS price_over_total,
count(*) FILTER (l_discount = 0) AS no_discount, count(*) FILTER (nullif(l_tax, 0) IS NULL) AS no_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def snapshot_audit(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return D.counted(j, {
        "shipped_before_order": F.col("l_shipdate") < F.col("o_orderdate"), "price_over_total": F.col("l_extendedprice") > F.col("o_totalprice"),
        "no_discount": F.col("l_discount") == 0, "no_tax": F.nullif("l_tax", F.lit(0.0)).isNull(),
    })


@plan("""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicated_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def duplicated_rows(t):
    return D.duplicated_rows(t.lineitem, ["l_orderkey", "l_linenumber"])


@plan("""WITH d AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'doc_id' AS "column", count(*) FILTER (doc_id IS NULL) AS missing FROM d UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM d UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM d""")
def missing_counts(t):
    return D.missing_counts(t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic"))


@plan("""WITH d AS (SELECT quality, toxic, n_chars FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS rows, count(*) FILTER (quality IS NULL) AS no_quality, count(*) FILTER (n_chars < 50 OR n_chars > 30000) AS bad_length, count(*) FILTER (quality IS NOT NULL AND n_chars BETWEEN 50 AND 30000) AS jointly_valid FROM d""")
def label_audit(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    size = F.col("n_chars").between(50, 30000)
    return D.counted(d, {"no_quality": F.col("quality").isNull(), "bad_length": ~size, "jointly_valid": F.col("quality").isNotNull() & size})


_FEATURES = "quality, toxic, n_chars, one"


@plan("""WITH d AS (SELECT substring(source, 1, 4) AS yr, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic, CAST(n_chars AS DOUBLE) AS n_chars, 1.0::DOUBLE AS one FROM documents LEFT JOIN labels USING (doc_id)),
l AS (SELECT yr, 'quality' AS feature, quality AS v FROM d UNION ALL SELECT yr, 'toxic', toxic FROM d UNION ALL SELECT yr, 'n_chars', n_chars FROM d UNION ALL SELECT yr, 'one', one FROM d),
y AS (SELECT feature, count(*) AS years FROM (SELECT feature, yr FROM l WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT feature, 100.0 * count(v) / count(*) AS availability, 100.0 * count(*) FILTER (v = 0) / count(v) AS zero_share, count(DISTINCT v) AS n_unique FROM l GROUP BY 1)
SELECT feature, round(availability, 4) AS availability, round(zero_share, 4) AS zero_share, n_unique, years,
CASE WHEN availability < 10 THEN 'low availability' WHEN n_unique <= 1 THEN 'constant' WHEN years < 2 THEN 'few years' WHEN feature = 'toxic' THEN 'not as-of safe' END AS reason FROM a JOIN y USING (feature)""")
def feature_audit(t):
    d = t.documents.join(t.labels, "doc_id", "left").select(F.substring("source", 1, 4).alias("yr"), "quality", "toxic", "n_chars", F.lit(1.0).alias("one"))
    out = D.feature_audit(d, ["quality", "toxic", "n_chars", "one"], "yr", unsafe=("toxic",))
    return out.select("feature", F.round("availability", 4).alias("availability"), F.round("zero_share", 4).alias("zero_share"), "n_unique", "years", "reason")


@plan("""SELECT user_id, field, count(DISTINCT v) AS n_values, string_agg(DISTINCT v, ' | ' ORDER BY v) AS values FROM (SELECT user_id, 'event_type' AS field, event_type AS v FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'
UNION ALL SELECT user_id, 'k', json_extract_string(props, '$.k') FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05') GROUP BY 1, 2 HAVING count(DISTINCT v) > 1""")
def conflicts(t):
    e = t.events.where(F.col("ts").cast("date") == F.lit("2024-01-05").cast("date")).withColumn("k", F.get_json_object("props", "$.k"))
    return D.conflicts(e, ["user_id"], ["event_type", "k"])


@plan("""WITH s AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2)
SELECT conv_id, max_by(CASE WHEN role = 'user' THEN text END, turn) FILTER (role = 'user') AS last_user, any_value(roles) AS role
FROM conversations JOIN (SELECT conv_id, string_agg(role, ' | ' ORDER BY f) AS roles FROM s GROUP BY 1) USING (conv_id) GROUP BY conv_id""")
def coalesce_parts(t):
    c = t.conversations.withColumn("last_user", F.when(F.col("role") == "user", F.col("text")))
    return D.coalesced_parts(c, "conv_id", "turn", ["last_user"], "role").select("conv_id", "last_user", "role")
