"""Every plan against DuckDB on the smallest tables, and what its physical plan may hold."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Plans that train models, and so run what pyspark.ml runs.
MODELS = {"model_selection", "residual_bands", "rolling_validation", "stage_specialists", "sector_correction", "group_selection", "residual_against_direct"}
MODELS |= {"residual_booster", "hazard_ratios", "quantile_bands", "absolute_loss_trees", "price_explanations", "composed_delay_model", "models_compared"}
#: Joins without a key that are by design: one side has a single row, is a checked set of focus rows, or both are the
#: small dimensions of a spine.
SINGLE_ROW = {
    "dist_stats", "row_split", "shifted_log", "exposure_rank", "topk_priority", "level_histogram", "hierarchical_fallback", "iqr_outliers", "residual_calibration", "shrunk_calibration", "smoothed_means", "robust_weights",
    "weighted_median", "weighted_quantile", "top_factors", "routed", "peer_benchmark", "coverage_gap", "out_of_fold_means", "residual_cap", "experiment_stages",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_the_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(cell(r[columns.index(c)]) for c in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_no_python_and_no_nested_loops(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
    if name not in SINGLE_ROW:
        assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = QUERIES["scan_prune_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text


def test_trailing_windows_share_one_exchange(spark):
    text = QUERIES["trailing_measures"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(user_id") <= 2  # one to pick a row a day, one for all windows


def test_entry_and_registry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_identities_tell_a_negative_zero_apart(spark, tmp_path):
    """The balance -0.0 has a name of its own in SQL, and a balance just below zero rounds to -0.0."""
    balances = [-0.0, 0.0, 3.2, -0.04, -0.05, 0.05, 1234.25, 1234.35, -7.75, None]
    customers = [(i, f"c{i}", 1, b, "A" if i < 3 else f"S{i}") for i, b in enumerate(balances)]
    orders = [(10 * i + k, i, "FP"[k], 1.0) for i in range(len(balances)) for k in (0, 1)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"file://{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"file://{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    for t in ("customer", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    columns = ("o_orderkey", "method", "confidence", "verified", "outcome_amount")
    got = sorted(map(repr, (tuple(r) for r in QUERIES["identity_resolve"](spark, f"file://{tmp_path}").select(*columns).collect())))
    assert got == sorted(map(repr, duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['identity_resolve']})").fetchall()))
    assert {f"({k}, 'exact_name_and_amount', 0.95, True, -0.0)" for k in (0, 31)} <= set(got)
