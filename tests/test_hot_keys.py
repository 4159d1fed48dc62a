"""Whole results when one order, part, customer, page or value holds a third of the rows."""

from __future__ import annotations

import os
import shutil

import duckdb
import pytest

from clustrial.checks import queries as queries_module
from clustrial.checks.compare import connect, difference
from clustrial.checks.oracles import ORACLES
from clustrial.checks.queries import QUERIES
from clustrial.sources import tables

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

# A third of the rows of each table get one and the same key or value.
HOT = {
    "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey)",
    "lineitem": """* REPLACE (
        CASE WHEN l_linenumber IN (1, 2) THEN 60 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN l_linenumber IN (3, 4) THEN 11 ELSE l_partkey END AS l_partkey,
        CASE WHEN l_linenumber IN (2, 5) THEN 1234.5 ELSE l_extendedprice END AS l_extendedprice)""",
    "events": """* REPLACE (
        CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id,
        CASE WHEN event_id % 3 = 0 THEN '{"k": 5}' ELSE props END AS props)""",
    "customer": "* REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 500.0 ELSE c_acctbal END AS c_acctbal)",
}
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.files.maxPartitionBytes": "16KB",
    "spark.sql.files.openCostInBytes": "1KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    for name in os.listdir(SF_DIR):
        table = name.removesuffix(".parquet")
        if table in HOT:
            duckdb.sql(
                f"COPY (SELECT {HOT[table]} FROM '{SF_DIR}/{name}') TO '{folder}/{name}' "
                "(FORMAT parquet, ROW_GROUP_SIZE 2048)"
            )
        else:
            shutil.copyfile(f"{SF_DIR}/{name}", folder / name)
    return str(folder)


@pytest.fixture(scope="module")
def hot_trial(spark, hot_dir):
    return queries_module.Trial(spark, hot_dir)


@pytest.fixture
def shuffled_joins(spark, monkeypatch, hot_trial):
    """No broadcasts, small skew limits, and every ordered table cut into slices."""
    monkeypatch.setattr(tables, "MIN_SLICES", 9)
    monkeypatch.setattr(queries_module, "Trial", lambda *_: hot_trial)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key in SETTINGS:
        spark.conf.unset(key)


@pytest.mark.parametrize(
    "name",
    [
        "measure_all_single_scan", "avg_rank_by_group", "allocate_stored_draw",
        "describe_percentiles", "ols_order_lines", "event_window_views", "event_window_alerts",
        "report_flatten",
    ],
)
def test_hot_tables_give_the_sql_result(spark, hot_dir, shuffled_joins, name):
    assert difference(QUERIES[name](spark, hot_dir), connect(hot_dir), ORACLES[name]) is None


def test_a_hot_order_is_split_across_tasks(spark, hot_dir, shuffled_joins):
    lines = queries_module.t.prescriptions(spark, hot_dir)
    lines.collect()
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan
