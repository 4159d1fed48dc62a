"""Column functions: missing values, periods, windows, dates and organisation ids."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from clustrial.functions import (
    ALERT_WINDOW,
    PAGE_VIEW_WINDOW,
    Periods,
    alert_org_type,
    cap_at,
    classify_period,
    date_text,
    days_between,
    event_window,
    has_keys,
    indicator,
    month_range,
    org_id,
    org_type,
    parse_compact_date,
    parse_iso_date,
    parse_visit_date,
    ratio,
    sum_or_zero,
)
from tests.conftest import rows

PERIODS = Periods(date(2018, 4, 1), date(2018, 10, 1), date(2019, 4, 1), date(2019, 10, 1))


def test_rows_with_a_null_key_are_left_out(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k STRING, v INT")
    assert rows(df.where(has_keys(["k"]))) == [("a", 1)]


def test_sum_of_nulls_is_zero_and_mean_skips_them(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 3.0), ("b", None)], "k STRING, v DOUBLE")
    out = df.groupBy("k").agg(sum_or_zero("v").alias("s"), F.avg("v").alias("m"))
    assert rows(out) == [("a", 0.0, None), ("b", 3.0, 3.0)]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (None, 2)], "n INT, d INT")
    assert [r[0] for r in df.select(ratio("n", "d")).collect()] == [None, 0.5, None]


def test_null_becomes_the_cap(spark):
    df = spark.createDataFrame([(1.0,), (9.0,), (None,)], "v DOUBLE")
    assert [r[0] for r in df.select(cap_at("v", 5.0)).collect()] == [1.0, 5.0, 5.0]


def test_unmapped_label_is_null(spark):
    df = spark.createDataFrame([("con",), ("I",), ("x",), (None,)], "a STRING")
    codes = df.select(indicator("a", {"con": 0, "I": 1})).collect()
    assert [r[0] for r in codes] == [0, 1, None, None]


@pytest.mark.parametrize(
    "month, period",
    [
        (date(2018, 3, 1), "before"),
        (date(2018, 4, 1), "baseline"),
        (date(2018, 9, 1), "baseline"),
        (date(2018, 10, 1), "mid"),
        (date(2019, 4, 1), "follow-up"),
        (date(2019, 10, 1), "after"),
        (None, "0"),
    ],
)
def test_periods_start_on_their_first_day(spark, month, period):
    df = spark.createDataFrame([(month,)], "month DATE")
    assert df.select(classify_period("month", PERIODS)).first()[0] == period


def test_month_range_includes_both_ends(spark):
    months = [(date(2018, m, 1),) for m in range(3, 12)]
    df = spark.createDataFrame(months, "month DATE")
    assert df.where(month_range("month", PERIODS.baseline, PERIODS.mid)).count() == 7


def test_page_view_and_alert_windows(spark):
    days = [-29, -28, -1, 0, 1, 28, 29, 84, 85, None]
    df = spark.createDataFrame([(d,) for d in days], "d INT")
    got = df.select(event_window("d", PAGE_VIEW_WINDOW), event_window("d", ALERT_WINDOW)).collect()
    assert [r[0] for r in got] == [
        "none", "before", "before", "none", "after", "after", "none", "none", "none", "none",
    ]
    assert [r[1] for r in got] == [
        "before", "before", "before", "after", "after", "after", "after", "after", "none", "none",
    ]


def test_dates_are_day_first(spark):
    texts = ["01/11/2018", "15/11/2018", "", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = df.select(parse_visit_date("t"), parse_visit_date("t", True)).collect()
    assert [r[0] for r in got] == [date(2018, 11, 1), date(2018, 11, 15), None, None, None]
    assert [r[1] for r in got] == [date(2018, 1, 11), date(2018, 11, 15), None, None, None]


def test_other_date_forms(spark):
    df = spark.createDataFrame([("2018-11-05", "20181105"), ("bad", "2018")], "a STRING, b STRING")
    got = df.select(parse_iso_date("a"), parse_compact_date("b")).collect()
    assert [tuple(r) for r in got] == [(date(2018, 11, 5), date(2018, 11, 5)), (None, None)]
    days = spark.sql("SELECT DATE '2018-11-05' a, TIMESTAMP '2018-11-02 23:59:00' b")
    assert days.select(days_between("a", "b"), date_text("b")).first()[:] == (-3, "2018-11-02")


def test_organisations_from_paths(spark):
    pages = ["/ccg/03E/lp", "/practice/A81001/lp", "/practice/A81001/?from=ccg", "/about"]
    df = spark.createDataFrame([(p,) for p in pages], "p STRING")
    got = df.select(org_id("p"), org_type("p"), org_id("p", True), org_type("p", True)).collect()
    assert [tuple(r) for r in got] == [
        ("03E", "ccg", "03E", "ccg"),
        ("A81001", "practice", "A81001", "practice"),
        ("A81001", "practice", "/pr", "ccg"),
        (None, "practice", "/about", "practice"),
    ]


def test_alert_types_by_id_length(spark):
    df = spark.createDataFrame(
        [("03E", None), (None, "A81001"), (None, "A81"), (None, None)], "pct STRING, practice STRING"
    )
    assert [r[0] for r in df.select(alert_org_type("pct", "practice")).collect()] == [
        "ccg", "practice", "none", "none",
    ]
    loose = df.select(alert_org_type("pct", "practice", practice_length=None)).collect()
    assert [r[0] for r in loose] == ["ccg", "practice", "practice", "none"]


def test_functions_work_on_a_stream(spark, tmp_path):
    source = tmp_path / "events"
    spark.sql("SELECT '/ccg/03E/lp' page, '20181106' day").write.json(str(source))
    stream = spark.readStream.schema("page STRING, day STRING").json(str(source))
    visit = F.lit("2018-11-05").cast("date")
    labelled = stream.withColumn("days", days_between(visit, parse_compact_date("day"))).select(
        org_id("page").alias("org"), event_window("days", PAGE_VIEW_WINDOW).alias("w")
    )
    query = labelled.writeStream.format("memory").queryName("labelled").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("labelled")) == [("03E", "after")]
