"""Distinct counts from bitmaps against sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from clustrial.operators.bitmaps import distinct_members, member_bitmaps
from tests.conftest import rows


def test_any_grouping_of_one_table_of_bitmaps(spark, sliced):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"day": rng.integers(0, 6, 5000), "kind": rng.choice(["a", "b"], 5000)})
    pdf["user"] = np.where(rng.random(5000) < 0.3, "hot", [f"u{i}" for i in rng.integers(0, 900, 5000)])
    bitmaps = member_bitmaps(spark.createDataFrame(pdf).repartition(5), "user", ["kind", "day"])
    for by in (["kind"], ["kind", "day"], ["day"], []):
        want = pdf.groupby(by)["user"].nunique().reset_index() if by else pd.DataFrame({"n": [pdf.user.nunique()]})
        assert rows(distinct_members(bitmaps, by)) == sorted(want.itertuples(index=False, name=None))


def test_more_members_than_a_bitmap_holds(spark):
    df = spark.range(100_000).selectExpr("id * 1000003 AS user", "id % 2 AS g")
    bitmaps = member_bitmaps(df.union(df), "user", ["g"])
    assert bitmaps.select("bucket").distinct().count() == 4
    assert rows(distinct_members(bitmaps, ["g"])) == [(0, 50_000), (1, 50_000)]
    assert distinct_members(bitmaps, []).first().n == 100_000


def test_missing_and_empty(spark):
    df = spark.createDataFrame([(None, "a", 1), ("u", None, 1), ("u", "a", 1), ("u", "a", 2), ("", "a", 2)], "user STRING, `a b` STRING, n INT")
    assert rows(distinct_members(member_bitmaps(df, "user", ["a b"]), ["a b"])) == [("a", 2)]
    assert rows(distinct_members(member_bitmaps(df, "user", ["n"]), ["n"], "users")) == [(1, 1), (2, 2)]
    assert member_bitmaps(df.limit(0), "user", ["n"]).count() == 0
    with pytest.raises(ValueError, match="bucket"):
        member_bitmaps(df.withColumn("bucket", df["n"]), "user", ["bucket"])
