"""Registered queries against their SQL, and the plans they run as."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from clustrial.checks import queries as queries_module
from clustrial.checks.compare import connect, difference
from clustrial.checks.oracles import ORACLES
from clustrial.checks.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# One of each kind; ``python -m clustrial.checks.compare <folder>`` runs them all.
CHECKED = [
    "measure_region_month", "measure_all_single_scan", "measure_code_list", "period_measure_rates",
    "avg_rank_by_group", "top_units_after_exclusion", "allocate_seeded", "trial_practices",
    "baseline_characteristics", "top3_per_cluster_rate", "ols_model", "ols_pvalues",
    "ols_order_lines", "sensitivity_flag", "describe_percentiles", "histogram_bins",
    "winsorise_upper", "parse_dates", "event_org_parse", "event_window_views_keep_empty",
    "ols_size_adjusted_practice", "csv_roundtrip", "report_flatten_ranges", "report_pages",
    "ols_nearly_collinear", "report_by_header", "report_rejected", "alerts_in_two_windows", "measure_from_catalog",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def trial_tables(spark):
    return queries_module.Trial(spark, SF_DIR)


@pytest.fixture
def one_trial(trial_tables, monkeypatch):
    """Let the queries share one trial's stored tables, as all of them read one folder."""
    monkeypatch.setattr(queries_module, "Trial", lambda *_: trial_tables)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, con, one_trial, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


@pytest.mark.parametrize(
    "name", ["avg_rank_by_group", "allocate_stored_draw", "describe_percentiles", "pct_rank_min"]
)
def test_same_as_sql_in_slices(spark, con, name, many_slices):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_measures_scan_the_fact_once_and_prune_columns(spark):
    plan = _plan(QUERIES["measure_all_single_scan"](spark, SF_DIR))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "lineitem" in line]
    assert len(scans) == 1
    assert "l_tax" not in scans[0] and "l_shipdate" not in scans[0]
    orders = [line for line in plan.splitlines() if "FileScan" in line and "orders.parquet" in line]
    assert all("GreaterThanOrEqual(o_orderdate" in line for line in orders)


def test_catalog_facts_meet_practices_without_a_shuffle(spark):
    facts, _, practices = queries_module.catalog_tables(spark, SF_DIR)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = facts.groupBy("practice", "month", "measure").agg({"items": "sum"})
        plan = _plan(joined.join(practices, joined["practice"] == practices["code"]))
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_cross_joins_without_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("measure_all_single_scan", "period_region_rates", "trial_practices"):
            plan = _plan(QUERIES[name](spark, SF_DIR))
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
            assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
