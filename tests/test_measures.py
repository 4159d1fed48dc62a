"""The measure table, and what it keeps whole."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
import pytest

from clustrial.operators.measures import (
    combine_measures,
    explode_measures,
    in_code_list,
    region_denominators,
    region_month_measures,
)
from tests.conftest import rows

FIRST, LAST = date(2018, 4, 1), date(2018, 6, 1)
MONTHS = [date(2018, m, 1) for m in (3, 4, 5, 6, 7)]


@pytest.fixture(scope="module")
def practices(spark):
    return spark.createDataFrame(
        [("P1", "01A", 4), ("P2", "01A", 4), ("P3", "02B", 4), ("P4", "02B", 1)],
        "code STRING, ccg_id STRING, setting INT",
    ).cache()


@pytest.fixture(scope="module")
def statistics(spark):
    data = [(p, m, 1000 * (i + 1)) for i, p in enumerate(["P1", "P2", "P3", "P4"]) for m in MONTHS]
    return spark.createDataFrame(data, "practice STRING, month DATE, total_list_size BIGINT").cache()


def test_a_row_counts_in_every_measure_it_matches(spark):
    df = spark.createDataFrame([(1, "ax"), (2, "b"), (3, None)], "id INT, code STRING")
    registry = {"a": "code LIKE 'a%'", "x": "code LIKE '%x'", "b": "code = 'b'"}
    assert rows(explode_measures(df, registry).select("id", "measure")) == [
        (1, "a"), (1, "x"), (2, "b"),
    ]


def test_code_list_does_not_repeat_rows(spark):
    df = spark.createDataFrame([("c1", 1), ("c2", 2), ("c1", 3)], "bnf_code STRING, v INT")
    codes = spark.createDataFrame([("c1",), ("c1",), ("c9",)], "bnf_code STRING")
    assert rows(in_code_list(df, codes, "bnf_code")) == [("c1", 1), ("c1", 3)]


def test_denominators_in_thousands_of_prescribing_practices(spark, practices, statistics):
    out = region_denominators(statistics, practices, FIRST, LAST)
    assert rows(out.where(out.pct_id == "02B"), "month", "denominator") == [
        (m, 3.0) for m in MONTHS[1:4]
    ]


def test_every_month_region_and_measure_has_a_row(spark, practices, statistics):
    facts = spark.createDataFrame(
        [("P1", MONTHS[1], "m", 2, 5.0), ("P4", MONTHS[1], "m", 9, 9.0), ("P3", MONTHS[0], "m", 9, 9.0)],
        "practice STRING, month DATE, measure STRING, items BIGINT, cost DOUBLE",
    )
    out = region_month_measures(facts, statistics, practices, ["m", "n"], FIRST, LAST)
    got = {(r.month, r.pct_id, r.measure): (r["items"], r.cost) for r in out.collect()}
    assert len(got) == 3 * 2 * 2
    assert got.pop((MONTHS[1], "01A", "m")) == (2, 5.0)
    assert set(got.values()) == {(0, 0.0)}


def test_hot_practice_gives_the_brute_force_result(spark, practices, statistics):
    rng = np.random.default_rng(7)
    n = 20_000
    pdf = pd.DataFrame(
        {
            "practice": np.where(rng.random(n) < 0.7, "P1", rng.choice(["P2", "P3", "P4"], n)),
            "month": rng.choice(np.array(MONTHS, dtype=object), n),
            "measure": rng.choice(["m", "n"], n),
            "items": rng.integers(1, 9, n),
            "cost": rng.integers(1, 1000, n).astype(float),
        }
    )
    facts = spark.createDataFrame(
        pdf, "practice STRING, month DATE, measure STRING, items BIGINT, cost DOUBLE"
    )
    out = region_month_measures(facts, statistics, practices, ["m", "n"], FIRST, LAST)
    region = {"P1": "01A", "P2": "01A", "P3": "02B"}
    kept = pdf[pdf.practice.isin(region) & (pdf.month >= FIRST) & (pdf.month <= LAST)]
    want = kept.groupby([kept.month, kept.practice.map(region), kept.measure])[["items", "cost"]].sum()
    got = {(r.month, r.pct_id, r.measure): (r["items"], r.cost) for r in out.collect()}
    assert got == {k: (v["items"], v["cost"]) for k, v in want.iterrows()}
    totals = combine_measures(out).agg({"items": "sum", "cost": "sum"}).first()
    assert set(totals) == {kept["items"].sum(), kept["cost"].sum()}


def test_null_region_is_dropped_when_measures_are_combined(spark):
    monthly = spark.createDataFrame(
        [(MONTHS[0], "01A", "m", 1, 2.0, 4.0), (MONTHS[0], "01A", "n", 2, 3.0, 4.0),
         (MONTHS[0], None, "m", 9, 9.0, 9.0)],
        "month DATE, pct_id STRING, measure STRING, items BIGINT, cost DOUBLE, denominator DOUBLE",
    )
    assert rows(combine_measures(monthly)) == [("01A", MONTHS[0], 3, 5.0, 4.0)]
