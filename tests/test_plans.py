"""Physical plans keep the properties the jobs rely on at scale."""

import re

import pytest

import __spark_entry__ as entry_module
from tests.conftest import SMALL

SINGLE_TASK = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"]
CHECKED = [
    "monthly_revenue", "customer_spend_leaderboard", "retention_rate", "market_penetration", "repair_sentinel_value",
    "range_join_windows", "visits_30days", "days_since_last_visit", "visit_gaps_30d", "churn_labels", "customer_age_grid",
    "featured_table", "enriched_featured_table", "market_panel", "asof_join_backward", "bounce_rate", "mean_visit_gap",
    "rfm_features", "lexicon_polarity", "column_quantiles", "winsorize_p99", "threshold_sweep", "silhouette_exact",
]


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return entry_module.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_join_and_no_python_rows(spark, name):
    # Joins on null-safe keys of hot-key and chunk tables are hash joins too.
    text = plan(spark, name)
    assert not [word for word in SINGLE_TASK if word in text]


@pytest.mark.parametrize("name", ["visits_30days", "churn_labels", "featured_table", "active_customers"])
def test_date_filter_reaches_the_scan(spark, name):
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan(spark, name))
    assert any("GreaterThan" in p and "o_orderdate" in p for p in pushed)


def test_only_needed_columns_are_read(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "monthly_revenue"))
    columns = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert columns == {"o_orderkey", "o_orderdate", "l_orderkey", "l_extendedprice"}


@pytest.mark.parametrize("name", ["visits_30days", "churn_labels", "retention_rate", "active_customers_grid"])
def test_one_exchange_is_enough(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") <= (2 if name in ("retention_rate", "churn_labels") else 1)


@pytest.mark.parametrize("name", ["asof_join_backward", "mean_visit_gap", "visit_gaps_30d"])
def test_fact_windows_run_per_chunk_on_one_shuffle(spark, name):
    text = plan(spark, name)
    # The facts are shuffled once, for the window and for the join that carries state over chunk borders;
    # the other two exchanges move the summary of the hot keys.
    assert text.count("Exchange hashpartitioning(_chunk") == 3
    assert re.search(r"SortMergeJoin \[_chunk[^]]*\], \[_chunk", text)
