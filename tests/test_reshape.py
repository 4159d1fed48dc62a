"""Pivots, descriptions, histograms, winsorising and arm summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from clustrial.operators.reshape import flatten_names, pivot_dense, pivot_sums
from clustrial.operators.robust import describe, group_means, histogram, histograms, trimming_report, winsorise
from clustrial.operators.summary import arm_summary, rounded_summary
from tests.conftest import rows

PERIODS = {"baseline": "baseline", "follow-up": "follow_up"}


def test_missing_period_is_null_and_null_value_is_zero(spark):
    df = spark.createDataFrame(
        [("a", "baseline", 1.0), ("a", "baseline", None), ("a", "follow-up", None),
         ("b", "baseline", 2.0), ("c", None, 5.0), (None, "baseline", 5.0)],
        "k STRING, period STRING, v DOUBLE",
    )
    out = pivot_sums(df, ["k"], "period", PERIODS, ["v"])
    assert out.columns == ["k", "v_baseline", "v_follow_up"]
    assert rows(out) == [("a", 1.0, 0.0), ("b", 2.0, None)]


def test_flatten_names(spark):
    assert flatten_names(spark.range(1).toDF("id_")).columns == ["id"]


def test_dense_grid_fills_categories_with_zero(spark):
    df = spark.createDataFrame(
        [("a", "ccg", "before", 3), ("a", "ccg", "none", 9), ("b", "practice", "after", 4)],
        "k STRING, kind STRING, timing STRING, v BIGINT",
    )
    out = pivot_dense(df, ["k"], "kind", ["ccg", "practice"], "timing", ["before", "after"], ["v"])
    assert rows(out) == [
        ("a", "ccg", 3, 0), ("a", "practice", 0, 0), ("b", "ccg", 0, 0), ("b", "practice", 0, 4),
    ]


def test_describe_equals_pandas(spark, sliced):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 2.0, 9.0, np.nan], "y": [5.0, 1.0, 4.0, 4.5, 2.5]})
    df = spark.createDataFrame(
        [(None if np.isnan(a) else a, b) for a, b in pdf.to_numpy().tolist()], "x DOUBLE, y DOUBLE"
    )
    got = describe(df, ["x", "y"]).toPandas().set_index("variable")
    want = pdf.describe().T
    for ours, theirs in zip(["count", "mean", "std", "min", "p25", "p50", "p75", "max"], want):
        np.testing.assert_allclose(got.loc[["x", "y"], ours], want[theirs], rtol=1e-12)


def test_histogram_equals_numpy_and_keeps_empty_bins(spark):
    values = [0.0, 0.5, 1.0, 9.9, 10.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE")
    counts, edges = np.histogram(values, bins=10)
    got = histogram(df, "v").orderBy("bin").collect()
    assert [r.n for r in got] == list(counts)
    np.testing.assert_allclose([r.lower for r in got], edges[:-1])
    same = histogram(df.where("v = 10"), "v").orderBy("bin").collect()
    assert [r.n for r in same] == list(np.histogram([10.0, 10.0], bins=10)[0])
    assert (same[0].lower, same[-1].upper) == (9.5, 10.5)
    assert histogram(df.where("v > 99"), "v").count() == 0


def test_all_histograms_in_one_pass(spark):
    data = [(1.0, 5, None), (2.0, 5, None), (float("inf"), 7, float("nan")), (float("-inf"), 6, None), (11.0, None, None)]
    df = spark.createDataFrame(data, "`a.b` DOUBLE, low INT, none DOUBLE")
    got = histograms(df, ["a.b", "low", "none"], 5)
    assert [r.n for r in got.where("variable = 'a.b'").orderBy("bin").collect()] == [3, 0, 0, 0, 2]
    assert [r.n for r in got.where("variable = 'low'").orderBy("bin").collect()] == [2, 0, 1, 0, 1]
    assert got.where("variable = 'none'").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_winsorising_caps_the_top_and_turns_null_into_the_cap(spark, sliced):
    values = [float(v) for v in range(1, 20)] + [1000.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE")
    cap = np.quantile(values, 0.95)
    got = [r[0] for r in winsorise(df, {"v": "w"}).select("w").collect()]
    np.testing.assert_allclose(sorted(got), sorted([*np.minimum(values, cap), cap]))


def test_caps_of_both_columns_use_the_whole_frame(spark):
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(101)], "a DOUBLE, b DOUBLE")
    out = winsorise(df, {"a": "pa", "b": "pb"})
    assert out.agg({"pa": "max", "pb": "max"}).first()[:] == (95.0, -5.0)
    again = winsorise(out.select("pa"), {"pa": "w"}).agg({"w": "max"}).first()[0]
    assert again <= 95.0
    assert winsorise(df.where("a < 0"), {"a": "pa"}).count() == 0


def test_approximate_caps(spark):
    df = spark.range(10_001).selectExpr("CAST(id AS DOUBLE) AS v")
    cap = winsorise(df, {"v": "w"}, accuracy=1000).agg({"w": "max"}).first()[0]
    assert abs(cap - 9500) < 20


def test_trimming_report(spark):
    df = spark.createDataFrame([("I", 1.0), ("con", 100.0), ("con", 3.0)], "allocation STRING, v DOUBLE")
    report = trimming_report(winsorise(df, {"v": "w"}), {"v": "w"})
    assert set(report) == {"describe", "means", "histograms"}
    assert rows(report["describe"], "variable", "count") == [("v", 3), ("w", 3)]
    assert rows(report["means"], "allocation")[0] == ("I",)
    bins = report["histograms"].groupBy("variable").agg({"n": "sum", "bin": "count"})
    assert rows(bins) == [("v", 3, 10), ("w", 3, 10)] or rows(bins) == [("v", 10, 3), ("w", 10, 3)]


def test_arm_summary(spark):
    df = spark.createDataFrame(
        [("x", "I", 1.0, 4.0), ("x", "I", 3.0, None), ("y", "con", 5.0, 2.0), ("z", None, 1.0, 1.0)],
        "joint_id STRING, arm STRING, b DOUBLE, a DOUBLE",
    )
    out = {r.arm: r for r in arm_summary(df, "arm", "b", "a", sums=True).collect()}
    assert set(out) == {"I", "con"}
    assert out["I"].units == 1 and out["I"].b_mean == 2.0 and out["I"].a_sum == 4.0
    assert out["I"].b_std == pytest.approx(2**0.5) and out["I"].change == 2.0
    assert out["con"].b_std is None and out["con"].change == -3.0


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([("a", 0.25), ("b", 0.35)], "arm STRING, v DOUBLE")
    got = rounded_summary(df.withColumn("joint_id", df.arm), "arm", ["v"])
    assert rows(got, "arm", "v_mean") == [("a", 0.2), ("b", 0.4)]
    means = group_means(df, "arm", ["v"])
    assert rows(means) == [("a", 0.25), ("b", 0.35)]
