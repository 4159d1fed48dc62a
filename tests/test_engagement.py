"""Page views, alert sign-ups and the pairing of visit dates."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from clustrial.plans.engagement import (
    cluster_alerts,
    cluster_list_sizes,
    cluster_page_views,
    pair_visit_dates,
    parse_page_views,
    trimmed_page_views,
)
from tests.conftest import rows

VISIT = date(2018, 11, 15)


def day(offset):
    return VISIT + timedelta(days=offset)


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame(
        [("01A", "I", "01A", 1), ("01A", "I", "02A", 1), ("03C", "con", "03C", 0), ("04D", "con", "04D", 0)],
        "joint_id STRING, allocation STRING, pct_id STRING, intervention INT",
    ).cache()


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(
        [("01A", "I", 1, 100.0, 1.0, VISIT), ("03C", "con", 0, 90.0, 1.0, VISIT),
         ("04D", "con", 0, 95.0, 2.0, None)],
        "joint_id STRING, allocation STRING, intervention INT, list_size DOUBLE, size_rank DOUBLE, "
        "date_int DATE",
    ).cache()


@pytest.fixture(scope="module")
def practices(spark):
    return spark.createDataFrame([("02A", "A81001"), ("03C", "B82002")], "ccg_id STRING, code STRING")


def _views(spark, data):
    return parse_page_views(spark.createDataFrame(data, "Page STRING, Date DATE, views BIGINT"))


VIEWS = [
    ("/ccg/01A/x", day(-28), 1), ("/ccg/01A/x", day(-29), 50), ("/ccg/01A/x", day(0), 50),
    ("/ccg/02A/x", day(-1), 2), ("/ccg/02A/y", day(28), 4), ("/ccg/02A/y", day(29), 50),
    ("/practice/A81001/x", day(1), 8), ("/practice/A81001/x", day(2), None),
    ("/practice/Z99999/x", day(1), 99), ("/ccg/09Z/x", day(1), 99),
    ("/practice/B82002/x", day(-3), 16),
]


def test_views_by_cluster_are_dense_over_org_types(spark, members, units, practices):
    out = cluster_page_views(_views(spark, VIEWS), members, practices, units)
    got = rows(out, "joint_id", "org_type", "views_before", "views_after", "pages_before", "pages_after")
    # Without any page view 04D has no row.
    assert got == [
        ("01A", "ccg", 3, 4, 2, 1), ("01A", "practice", 0, 8, 0, 1),
        ("03C", "ccg", 0, 0, 0, 0), ("03C", "practice", 16, 0, 1, 0),
    ]


def test_clusters_without_views_can_be_kept(spark, members, units, practices):
    out = cluster_page_views(_views(spark, VIEWS), members, practices, units, keep_empty=True)
    assert rows(out, "joint_id", "org_type", "views_before")[-2:] == [
        ("04D", "ccg", 0), ("04D", "practice", 0),
    ]


def test_an_org_type_never_seen_has_no_rows(spark, members, units, practices):
    out = cluster_page_views(_views(spark, VIEWS[:4]), members, practices, units)
    assert {r.org_type for r in out.collect()} == {"ccg"}


def test_trimmed_views_use_one_org_type(spark, members, units, practices):
    grid = cluster_page_views(_views(spark, VIEWS), members, practices, units)
    out = trimmed_page_views(grid, "practice")
    assert rows(out, "joint_id", "proxy_views_after") == [("01A", pytest.approx(7.6)), ("03C", 0.0)]


def test_hot_page_is_summed_whole(spark, members, units, practices):
    views = spark.range(5000).selectExpr(
        "CASE WHEN id < 4000 THEN '/ccg/01A/x' ELSE concat('/ccg/03C/p', id % 50) END AS Page",
        "date_add(DATE '2018-11-15', CAST(1 + id % 20 AS INT)) AS Date",
        "CAST(1 AS BIGINT) AS views",
    )
    out = cluster_page_views(parse_page_views(views.repartition(6)), members, practices, units)
    assert rows(out, "joint_id", "views_after", "pages_after") == [("01A", 4000, 1), ("03C", 1000, 50)]


def test_controls_take_the_date_of_the_equally_ranked_visit(spark, sliced):
    members = spark.createDataFrame(
        [("a", "I", "a", 1), ("a", "I", "a2", 1), ("b", "I", "b", 1), ("c", "con", "c", 0),
         ("d", "con", "d", 0), ("e", "con", "e", 0)],
        "joint_id STRING, allocation STRING, pct_id STRING, intervention INT",
    )
    sizes = spark.createDataFrame(
        [("a", 30.0), ("b", 20.0), ("c", 5.0), ("d", 9.0), ("e", 12.0)], "joint_id STRING, list_size DOUBLE"
    )
    timetable = spark.createDataFrame(
        [("a", date(2018, 11, 1)), ("b", None)], "joint_id STRING, date DATE"
    )
    out = pair_visit_dates(members, timetable, sizes)
    assert rows(out, "joint_id", "size_rank", "date_int") == [
        ("a", 2.0, date(2018, 11, 1)), ("b", 1.0, None), ("c", 1.0, None),
        ("d", 2.0, date(2018, 11, 1)), ("e", 3.0, None),
    ]


def test_tied_sizes_match_equal_half_ranks_only(spark):
    members = spark.createDataFrame(
        [(c, a, c, int(a == "I")) for c, a in zip("abcd", ("I", "I", "con", "con"))],
        "joint_id STRING, allocation STRING, pct_id STRING, intervention INT",
    )
    timetable = spark.createDataFrame([("a", VISIT), ("b", VISIT)], "joint_id STRING, date DATE")
    sizes = spark.createDataFrame(
        [("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 2.0)], "joint_id STRING, list_size DOUBLE"
    )
    out = pair_visit_dates(members, timetable, sizes)
    assert rows(out.where("allocation = 'con'"), "joint_id", "size_rank", "date_int") == [
        ("c", 1.0, None), ("d", 2.0, None),
    ]


def test_list_size_sums_over_member_regions(spark, members):
    sizes = spark.createDataFrame([("01A", 5), ("02A", 6)], "pct_id STRING, list_size BIGINT")
    assert rows(cluster_list_sizes(members, sizes)) == [("01A", 11), ("03C", 0), ("04D", 0)]


def test_alerts_count_users_once_and_keep_empty_clusters(spark, members, units, practices):
    def at(offset, hour=9):
        return datetime.combine(day(offset), datetime.min.time()).replace(hour=hour)

    alerts = spark.createDataFrame(
        [
            (at(-400), "t", "01A", None, "u1"),  # before, however early
            (at(-1, 23), "t", "02A", None, "u1"),  # same user, same cluster
            (at(0), "t", "01A", None, "u2"),  # the day itself is after
            (at(84), "t", None, "A81001", "u3"),
            (at(85), "t", None, "A81001", "u4"),  # too late
            (at(5), "f", None, "A81001", "u5"),  # not approved
            (at(5), "t", None, "Z99999", "u6"),  # not in the trial
            (at(-5), "t", None, "B82002", "u7"),
            (at(-5), "t", None, "B82002", None),
        ],
        "created_at TIMESTAMP, approved STRING, pct STRING, practice STRING, user STRING",
    )
    out = cluster_alerts(alerts, members, practices, units)
    assert rows(
        out, "joint_id", "alerts_ccg_after", "alerts_ccg_before", "alerts_practice_after",
        "alerts_practice_before",
    ) == [("01A", 1, 1, 1, 0), ("03C", 0, 0, 0, 1), ("04D", 0, 0, 0, 0)]
    assert rows(out, "joint_id", "list_size_100k")[0] == ("01A", 0.001)


def test_region_alerts_do_not_match_a_null_practice_code(spark, members, units):
    practices = spark.createDataFrame([("03C", None)], "ccg_id STRING, code STRING")
    alerts = spark.createDataFrame(
        [(datetime(2018, 11, 16), "t", "01A", None, "u")],
        "created_at TIMESTAMP, approved STRING, pct STRING, practice STRING, user STRING",
    )
    out = cluster_alerts(alerts, members, practices, units)
    assert rows(out, "joint_id", "alerts_ccg_after") == [("01A", 1), ("03C", 0), ("04D", 0)]
