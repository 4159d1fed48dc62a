"""Teams, rosters and allocation."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clustrial.operators.allocation import allocate
from clustrial.operators.clusters import (
    expand_roster,
    map_to_clusters,
    roll_up,
    roster_practices,
    team_representatives,
)
from clustrial.plans.trial import rank_clusters, select_and_allocate, visit_list, with_team_names
from tests.conftest import rows


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame(
        [("9A", "T"), ("99K", "T"), ("05V", "S"), ("01V", "U"), ("02V", "U"), ("03V", "U")],
        "ccg_id STRING, joint_team STRING",
    )


def test_the_last_id_in_text_order_represents_a_team(teams):
    assert rows(team_representatives(teams)) == [("S", 1, "05V"), ("T", 2, "9A"), ("U", 3, "03V")]


def test_regions_without_a_team_stand_for_themselves(spark, teams):
    regions = spark.createDataFrame([("99K", 1.0), ("07X", 2.0)], "pct_id STRING, numerator DOUBLE")
    out = map_to_clusters(regions, teams)
    assert rows(out, "pct_id", "joint_id", "joint_team") == [("07X", "07X", None), ("99K", "9A", "T")]


def test_roll_up_sums_nulls_to_zero_and_drops_null_clusters(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None), (None, 1.0)], "k STRING, v DOUBLE")
    assert rows(roll_up(df, ["k"], ["v"])) == [("a", 2.0), ("b", 0.0)]


def test_roster_expands_named_teams_only(spark, teams):
    roster = spark.createDataFrame(
        [("9A", "I"), ("03V", "con"), ("07X", "con")], "joint_id STRING, allocation STRING"
    )
    named = with_team_names(roster, teams)
    by_name = expand_roster(named, teams)
    assert rows(by_name, "joint_id", "pct_id", "intervention") == [
        ("03V", "03V", 0), ("07X", "07X", 0), ("9A", "99K", 1), ("9A", "9A", 1),
    ]
    by_id = expand_roster(roster, teams, expand_by="joint_id")
    assert [r[1] for r in rows(by_id, "joint_id", "pct_id")] == [
        "01V", "02V", "03V", "07X", "99K", "9A",
    ]


def test_only_open_prescribing_practices_of_the_trial(spark):
    members = spark.createDataFrame([("01A",), ("01A",)], "pct_id STRING")
    practices = spark.createDataFrame(
        [("P1", "01A", 4, "A"), ("P1", "01A", 4, "A"), ("P2", "01A", 4, "C"),
         ("P3", "01A", 1, "A"), ("P4", "02B", 4, "A"), ("P5", "01A", 4, None)],
        "code STRING, ccg_id STRING, setting INT, status_code STRING",
    )
    assert rows(roster_practices(members, practices)) == [("01A", "P1")]


@pytest.mark.parametrize("n", [1, 2, 39, 40])
def test_arms_are_balanced_and_do_not_depend_on_partitioning(spark, sliced, n):
    units = spark.createDataFrame([(f"{i:02d}X",) for i in range(n)], "joint_id STRING")
    first = rows(allocate(units.repartition(1), 321), "joint_id", "allocation")
    assert first == rows(allocate(units.repartition(7), 321), "joint_id", "allocation")
    arms = [a for _, a in first]
    assert abs(arms.count("I") - arms.count("con")) <= 1


def test_another_seed_gives_another_allocation(spark):
    units = spark.createDataFrame([(f"{i:02d}X",) for i in range(40)], "joint_id STRING")
    one, two = (
        rows(allocate(units, seed=s), "joint_id", "allocation") for s in (321, 322)
    )
    assert one != two


def test_stored_draws_are_replayed(spark, sliced):
    draws = [("01X", 0.886), ("99K", 0.078), ("01J", 0.98), ("09W", 0.248)]
    df = spark.createDataFrame(draws, "joint_id STRING, rand_num DOUBLE")
    out = allocate(df, draw="rand_num")
    assert rows(out, "joint_id", "allocation_ranking", "allocation") == [
        ("01J", 4.0, "con"), ("01X", 3.0, "I"), ("09W", 2.0, "con"), ("99K", 1.0, "I"),
    ]


def test_clusters_are_ranked_before_exclusion(spark, sliced):
    df = spark.createDataFrame(
        [(c, float(i)) for i, c in enumerate("abcdefgh")], "joint_id STRING, baseline DOUBLE"
    )
    ranks = dict(rows(rank_clusters(df), "joint_id", "baseline_ranking"))
    assert ranks["h"] == 1.0 and ranks["a"] == 1 / 8
    chosen = select_and_allocate(df, ["g"], k=4, seed=321)
    assert rows(chosen, "joint_id") == [("d",), ("e",), ("f",), ("h",)]
    assert chosen.where(F.col("allocation") == "I").count() == 2


def test_visit_list_names_teams(spark, teams):
    allocation = spark.createDataFrame(
        [("9A", "I"), ("07X", "I"), ("03V", "con")], "joint_id STRING, allocation STRING"
    )
    names = spark.createDataFrame([("9A", "Nine"), ("03V", "Three")], "code STRING, name STRING")
    assert rows(visit_list(allocation, names, teams)) == [
        ("07X", None, None, None), ("9A", "Nine", "T", 2),
    ]
