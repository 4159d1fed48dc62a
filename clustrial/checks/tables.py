"""The trial's tables, read off the order, customer, part and event tables.

A customer is a practice, a nation and market segment a region, an order line a
prescription, and an event a page view or an alert.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from clustrial.functions import Periods, Window
from clustrial.operators.measures import explode_measures
from clustrial.sources.tables import read_table

PERIODS = Periods(
    baseline=date(1997, 4, 1),
    mid=date(1997, 10, 1),
    follow_up=date(1998, 4, 1),
    after=date(1998, 10, 1),
)
FIRST, LAST = PERIODS.baseline, PERIODS.after  # months fetched, both included
EXCLUDED = ["01A", "02B", "03F"]
SEED, TRIAL_SIZE = 321, 40
PAGE_WINDOW = Window(before=(-7, -1), after=(1, 7))
SIGNUP_WINDOW = Window(before=(None, -1), after=(0, 10))

KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SIZES = {"s": "p_size < 17", "m": "p_size >= 17 AND p_size < 34", "l": "p_size >= 34"}
# 18 disjoint measures, and two by brand that overlap them.
REGISTRY = {
    **{
        f"{kind.lower()}_{size}": f"p_type = '{kind}' AND {rule}"
        for kind in KINDS
        for size, rule in SIZES.items()
    },
    "brand_7": "p_brand = 'Brand#7'",
    "brand_1x": "p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')",
}
MEASURES = list(REGISTRY)
CODE_LIST_BRAND = "Brand#1"


# Column types as stored; naming them saves a pass over the file footers.
TABLES = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", TABLES[name], columns)


REGION_ID = "concat(lpad(CAST(c_nationkey AS STRING), 2, '0'), substring(c_mktsegment, 1, 1))"


def practices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, code_text, ccg_id, setting, status_code``."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS code",
        "format_string('P%05d', c_custkey) AS code_text",
        f"{REGION_ID} AS ccg_id",
        "CASE WHEN c_acctbal >= 0 THEN 4 ELSE 1 END AS setting",
        "CASE WHEN c_acctbal >= 9500 THEN 'C' ELSE 'A' END AS status_code",
    )


def orders_between(
    spark: SparkSession, sf_dir: str, first: date, last: date, *columns: str
) -> DataFrame:
    """Orders of the months, filtered on the stored date so that the scan can skip."""
    past_last = date(last.year + last.month // 12, last.month % 12 + 1, 1)
    return (
        table(spark, sf_dir, "orders")
        .where(f"o_orderdate >= DATE'{first}' AND o_orderdate < DATE'{past_last}'")
        .selectExpr("o_custkey AS practice", "trunc(o_orderdate, 'month') AS month", *columns)
    )


def statistics(
    spark: SparkSession, sf_dir: str, first: date = FIRST, last: date = LAST
) -> DataFrame:
    size = "CAST(o_totalprice AS DECIMAL(18, 2))"
    return orders_between(
        spark,
        sf_dir,
        first,
        last,
        f"{size} AS total_list_size",
        f"CASE WHEN o_orderpriority = '1-URGENT' THEN {size} ELSE 0 END AS over_65",
    )


def prescriptions(
    spark: SparkSession, sf_dir: str, first: date = FIRST, last: date = LAST
) -> DataFrame:
    """``practice, month, part, items, cost``: order lines of the months."""
    orders = orders_between(spark, sf_dir, first, last, "o_orderkey AS order")
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order",
        "l_partkey AS part",
        "CAST(l_quantity AS BIGINT) AS items",
        "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4)) AS cost",
    )
    return lines.join(orders, "order").drop("order")


def parts_by_measure(
    spark: SparkSession, sf_dir: str, registry: Mapping[str, str] = REGISTRY
) -> DataFrame:
    """``part, measure``: predicates run once per part, not once per order line."""
    return explode_measures(table(spark, sf_dir, "part"), registry).selectExpr(
        "p_partkey AS part", "measure"
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of segment A or B in the first world region work in one team per nation."""
    prefix = "lpad(CAST(n_nationkey AS STRING), 2, '0')"
    return (
        table(spark, sf_dir, "nation")
        .where("n_regionkey = 0")
        .selectExpr(
            f"explode(array(concat({prefix}, 'A'), concat({prefix}, 'B'))) AS ccg_id",
            "concat('TEAM ', n_name) AS joint_team",
        )
    )


def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, name``: one row per region, named by nation and segment."""
    customer = table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment").distinct()
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
    return customer.join(nation, "c_nationkey").selectExpr(
        f"{REGION_ID} AS code", "concat_ws(' ', n_name, c_mktsegment) AS name"
    )


def visit_timetable(spark: SparkSession, sf_dir: str, allocation: DataFrame) -> DataFrame:
    """``joint_id, date`` for intervention clusters; day-first text, empty if not visited."""
    visit = "date_add(DATE'2024-01-08', CAST(floor(n_nationkey / 2) AS INT))"
    nation = table(spark, sf_dir, "nation").selectExpr(
        "lpad(CAST(n_nationkey AS STRING), 2, '0') AS prefix",
        f"CASE WHEN n_regionkey = 3 THEN '' ELSE date_format({visit}, 'dd/MM/yyyy') END AS date",
    )
    visited = allocation.where("allocation = 'I'").selectExpr(
        "joint_id", "substring(joint_id, 1, 2) AS prefix"
    )
    return visited.join(nation, "prefix").select("joint_id", "date")


def events_with_org(spark: SparkSession, sf_dir: str, kinds: str) -> DataFrame:
    orgs = practices(spark, sf_dir).selectExpr("code AS user_id", "code_text", "ccg_id AS region")
    return (
        table(spark, sf_dir, "events")
        .where(f"event_type IN ({kinds})")
        .selectExpr("ts", "user_id", "event_type", "value", "get_json_object(props, '$.k') AS k")
        .join(orgs, "user_id")
    )


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Page, Date, views``: views hit region pages, clicks practice pages."""
    return events_with_org(spark, sf_dir, "'view', 'click'").selectExpr(
        "CASE WHEN event_type = 'view' THEN concat('/ccg/', region, '/lp', k) "
        "ELSE concat('/practice/', code_text, '/lp', k) END AS Page",
        "to_date(ts) AS Date",
        "CAST(floor(value / 100) + 1 AS BIGINT) AS views",
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``created_at, approved, pct, practice, user``: sign-ups of a region or a practice."""
    return events_with_org(spark, sf_dir, "'signup'").selectExpr(
        "ts AS created_at",
        "CASE WHEN value >= 20 THEN 't' ELSE 'f' END AS approved",
        "CASE WHEN value >= 60 THEN region END AS pct",
        "CASE WHEN value < 60 THEN code_text END AS practice",
        "k AS user",
    )
