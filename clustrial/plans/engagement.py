"""Page views and alert sign-ups before and after a visit, by cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.functions import (
    ALERT_WINDOW,
    PAGE_VIEW_WINDOW,
    Window,
    alert_org_type,
    event_window,
    has_keys,
    nan_as_missing,
    org_id,
    org_type,
    sum_or_zero,
)
from clustrial.operators.bitmaps import distinct_members, member_bitmaps
from clustrial.operators.clusters import roll_up
from clustrial.operators.positions import add_rank
from clustrial.operators.reshape import pivot_dense
from clustrial.operators.robust import winsorise
from clustrial.operators.summary import arm_summary
from clustrial.sources.tables import store

ORG_TYPES = ["ccg", "practice"]  # Fixed values: the kinds of organisation page.
ALERT_CELLS = {
    f"alerts_{kind}_{when}": f"org_type = '{kind}' AND timing = '{when}'"
    for kind in ORG_TYPES
    for when in ("after", "before")
}
REGION_ID_LENGTH = 3  # Fixed value: region ids have three characters.


def cluster_list_sizes(members: DataFrame, list_sizes: DataFrame) -> DataFrame:
    """Patients per cluster: the sum over its member regions, 0 where unknown."""
    joined = members.select("joint_id", "pct_id").join(list_sizes, "pct_id", "left")
    return roll_up(joined, ["joint_id"], ["list_size"])


def pair_visit_dates(
    members: DataFrame, timetable: DataFrame, sizes: DataFrame
) -> DataFrame:
    """One row per cluster with ``date_int``, its own or its partner's visit date.

    Clusters are ranked by size within their arm, and each takes the date of the
    intervention cluster of equal rank. Tied sizes share an x.5 rank, which only an
    equal x.5 rank matches. ``timetable`` has ``joint_id`` and a date column ``date``.
    """
    units = (
        members.join(timetable, "joint_id", "left")
        .select("joint_id", "allocation", "intervention", "date")
        .distinct()
        .join(sizes, "joint_id")
    )
    ranked = add_rank(store(units, "units"), "list_size", "size_rank", ["allocation"])
    visited = ranked.where(F.col("allocation") == "I").select(
        "size_rank", F.col("date").alias("date_int")
    )
    return ranked.join(visited, "size_rank", "left").select(
        "joint_id", "allocation", "intervention", "list_size", "size_rank", "date_int"
    )


def parse_page_views(views: DataFrame, literal: bool = False) -> DataFrame:
    """``Page, Date, views`` with the organisation's id and type read off the path."""
    return views.withColumn("org_id", org_id("Page", literal)).withColumn(
        "org_type", org_type("Page", literal)
    )


def cluster_page_views(
    views: DataFrame,
    members: DataFrame,
    practices: DataFrame,
    units: DataFrame,
    window: Window = PAGE_VIEW_WINDOW,
    keep_empty: bool = False,
) -> DataFrame:
    """Views and distinct pages before and after the visit, per cluster and org type.

    ``views`` comes from ``parse_page_views``, ``practices`` from ``roster_practices``.
    Every cluster seen gets a row for every org type seen, zero-filled. A cluster
    without any views has no row unless ``keep_empty``. Views are summed by page and
    day before they meet a join, so the joins see one row per page and day however
    popular the page.
    """
    daily = views.groupBy("org_id", "org_type", "Page", "Date").agg(F.sum("views").alias("views"))
    by_code = practices.select(F.col("code").alias("org_id"), "ccg_id")
    regional = (
        daily.join(by_code, "org_id", "left")
        .selectExpr(
            f"CASE WHEN length(org_id) = {REGION_ID_LENGTH} THEN org_id ELSE ccg_id END AS pct_id",
            "org_type",
            "Page",
            "Date",
            "views",
        )
    )
    trial = members.select("joint_id", "pct_id").join(
        units.select("joint_id", "intervention", "list_size", "date_int"), "joint_id"
    )
    unit_keys = ["joint_id", "intervention", "list_size"]
    keys = [*unit_keys, "org_type", "timing"]
    pages = (
        regional.join(trial, "pct_id")
        .withColumn("timing", event_window("datediff(Date, date_int)", window))
        .where(has_keys(keys))
        .groupBy(*keys, "Page")
        .agg(F.sum("views").alias("views"))
    )
    totals = store(
        pages.groupBy(*keys).agg(
            sum_or_zero("views").alias("views"), F.count("Page").alias("pages")
        ),
        "page-views",
    )
    filled = totals
    if keep_empty:
        missing = units.select(*unit_keys).distinct().join(totals, "joint_id", "left_anti")
        filled = totals.unionByName(missing, allowMissingColumns=True)
    dense = pivot_dense(
        filled, unit_keys, "org_type", ORG_TYPES, "timing", ["before", "after"], ["views", "pages"]
    )
    return dense.join(totals.select("org_type").distinct(), "org_type", "left_semi").select(
        *unit_keys, "org_type", "views_before", "views_after", "pages_before", "pages_after"
    )


def trimmed_page_views(grid: DataFrame, kind: str) -> DataFrame:
    """Clusters' views of one org type, capped at the 95th percentile of all clusters."""
    return winsorise(
        store(grid.where(F.col("org_type") == kind), "page-view-grid"),  # one row per cluster, read three times
        {"views_before": "proxy_views_before", "views_after": "proxy_views_after"},
    )


def cluster_alerts(
    alerts: DataFrame,
    members: DataFrame,
    practices: DataFrame,
    units: DataFrame,
    window: Window = ALERT_WINDOW,
    practice_length: int | None = 6,
) -> DataFrame:
    """Users with approved alerts before and after the visit, per cluster and org type.

    ``alerts`` has ``created_at, approved, pct, practice, user``. Region alerts carry
    no practice and match none. Clusters without alerts keep a row of zeros.
    """
    approved = _approved_alerts(alerts, practices, practice_length)
    trial = members.select("joint_id", "pct_id").join(
        units.select("joint_id", "date_int"), "joint_id"
    )
    users = (
        approved.join(trial, "pct_id")
        .withColumn("timing", event_window("datediff(created, date_int)", window))
        .where(F.col("user").isNotNull())
        .groupBy("joint_id", "org_type", "timing", "user")
        .agg(F.lit(1).alias("seen"))
    )
    counts = users.groupBy("joint_id").agg(
        *[F.expr(f"count_if({test}) AS {name}") for name, test in ALERT_CELLS.items()]
    )
    return _every_cluster(units, counts)


def _approved_alerts(alerts: DataFrame, practices: DataFrame, practice_length: int | None) -> DataFrame:
    """Users with approved alerts by day, region and kind of organisation."""
    by_code = practices.select(F.col("code").alias("practice"), "ccg_id")
    return (
        alerts.where(F.col("approved") == "t")
        .withColumn("created", F.to_date("created_at"))
        .groupBy("practice", "pct", "user", "created")
        .agg(F.lit(1).alias("seen"))
        .join(by_code, "practice", "left")
        .withColumn("pct_id", F.coalesce("ccg_id", "pct"))
        .withColumn("org_type", alert_org_type("pct", "practice", practice_length=practice_length))
    )


def alert_bitmaps(alerts: DataFrame, practices: DataFrame, practice_length: int | None = 6) -> DataFrame:
    """Users with approved alerts as bitmaps by region, kind of organisation and day.

    Stored once, they give ``cluster_alerts_in`` for any window and any clusters.
    """
    return member_bitmaps(
        _approved_alerts(alerts, practices, practice_length), "user", ["pct_id", "org_type", "created"]
    )


def cluster_alerts_in(
    bitmaps: DataFrame, members: DataFrame, units: DataFrame, window: Window = ALERT_WINDOW
) -> DataFrame:
    """As ``cluster_alerts``, from the bitmaps of ``alert_bitmaps``."""
    trial = members.select("joint_id", "pct_id").join(units.select("joint_id", "date_int"), "joint_id")
    timed = bitmaps.join(trial, "pct_id").withColumn("timing", event_window("datediff(created, date_int)", window))
    found = distinct_members(timed, ["joint_id", "org_type", "timing"], "users")
    counts = found.groupBy("joint_id").agg(
        *[F.expr(f"coalesce(sum(users) FILTER (WHERE {test}), 0) AS {name}") for name, test in ALERT_CELLS.items()]
    )
    return _every_cluster(units, counts)


def _every_cluster(units: DataFrame, counts: DataFrame) -> DataFrame:
    clusters = units.select("intervention", "joint_id", "list_size").distinct()
    return clusters.join(counts, "joint_id", "left").selectExpr(
        "intervention",
        "joint_id",
        "CAST(list_size AS DOUBLE) / 100000 AS list_size_100k",
        *[f"coalesce({name}, 0) AS {name}" for name in ALERT_CELLS],
    )


def alert_summary(counts: DataFrame, kind: str) -> DataFrame:
    """Alerts of one org type by arm before and after, with mean and SD of the list size."""
    alerts = arm_summary(counts, "intervention", f"alerts_{kind}_before", f"alerts_{kind}_after").toDF(
        "intervention", "units", "before_mean", "before_std", "after_mean", "after_std", "change"
    )
    sizes = (
        nan_as_missing(counts, ["intervention", "list_size_100k"])
        .where(has_keys(["intervention"]))
        .groupBy("intervention")
        .agg(F.avg("list_size_100k").alias("size_mean"), F.stddev_samp("list_size_100k").alias("size_std"))
    )
    return alerts.join(sizes, "intervention")
