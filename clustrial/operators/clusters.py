"""Teams of regions as clusters, and the roster of clusters in a trial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.functions import has_keys, indicator, sum_or_zero

ARM_CODES = {"con": 0, "I": 1}  # Fixed values: control and intervention.


def team_representatives(teams: DataFrame) -> DataFrame:
    """Per team, its number of members and the last member id as the team's id."""
    return (
        teams.where(F.col("joint_team").isNotNull())
        .groupBy("joint_team")
        .agg(F.count("ccg_id").alias("CCGs_included"), F.max("ccg_id").alias("joint_id"))
    )


def map_to_clusters(regions: DataFrame, teams: DataFrame, region: str = "pct_id") -> DataFrame:
    """Add ``joint_id``: the id of the region's team, or the region's own id."""
    members = teams.join(team_representatives(teams), "joint_team").select(
        F.col("ccg_id").alias("_member"), F.col("joint_id").alias("_team_id"), "joint_team"
    )
    return (
        regions.join(members, F.col(region) == F.col("_member"), "left")
        .withColumn("joint_id", F.coalesce("_team_id", region))
        .drop("_member", "_team_id")
    )


def roll_up(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums by cluster; a sum of nulls is 0, a null key drops the row."""
    return df.where(has_keys(keys)).groupBy(*keys).agg(*[sum_or_zero(c).alias(c) for c in sums])


def expand_roster(
    roster: DataFrame, teams: DataFrame, expand_by: str = "joint_team"
) -> DataFrame:
    """One row per member region of each cluster: ``joint_id, allocation, pct_id``.

    By ``joint_team`` only rows naming their team are expanded, so a cluster listed
    without one stays a single region. By ``joint_id`` a cluster is expanded
    whenever its id represents a team.
    """
    if expand_by == "joint_team":
        members = teams.select("joint_team", F.col("ccg_id").alias("_member"))
    else:
        members = teams.join(team_representatives(teams), "joint_team").select(
            "joint_id", F.col("ccg_id").alias("_member")
        )
    return roster.join(members, expand_by, "left").select(
        "joint_id",
        "allocation",
        F.coalesce("_member", "joint_id").alias("pct_id"),
        indicator("allocation", ARM_CODES).alias("intervention"),
    )


def roster_practices(members: DataFrame, practices: DataFrame) -> DataFrame:
    """Open prescribing practices of the trial's regions: ``ccg_id, code``."""
    open_practices = (
        practices.where((F.col("setting") == 4) & (F.col("status_code") != "C"))
        .select("ccg_id", "code")
        .distinct()
    )
    trial_regions = members.select(F.col("pct_id").alias("ccg_id"))
    return open_practices.join(trial_regions, "ccg_id", "left_semi")
