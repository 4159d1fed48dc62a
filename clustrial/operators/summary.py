"""Summary of a before/after outcome by arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.functions import has_keys, nan_as_missing, quoted


def arm_summary(
    df: DataFrame,
    arm: str,
    before: str,
    after: str,
    unit: str = "joint_id",
    sums: bool = False,
) -> DataFrame:
    """Units, mean and sample SD before and after, and the change of the mean."""
    df = nan_as_missing(df, [arm, before, after])
    moments = [
        F.expr(f"{function}({quoted(c)}) AS {quoted(f'{c}_{name}')}")
        for c in (before, after)
        for name, function in {"mean": "avg", "std": "stddev_samp"}.items()
    ]
    totals = [F.sum(c).alias(f"{c}_sum") for c in (before, after)] if sums else []
    return (
        df.where(has_keys([arm]))
        .groupBy(arm)
        .agg(F.countDistinct(unit).alias("units"), *moments, *totals)
        .withColumn(
            "change", F.expr(f"{quoted(f'{after}_mean')} - {quoted(f'{before}_mean')}")
        )
    )


def rounded_summary(
    df: DataFrame, arm: str, columns: list[str], unit: str = "joint_id", places: int = 1
) -> DataFrame:
    """Units, mean and sample SD of several columns by arm, rounded half to even."""
    df = nan_as_missing(df, [arm, *columns])
    return (
        df.where(has_keys([arm]))
        .groupBy(arm)
        .agg(
            F.count(unit).alias("units"),
            *[F.bround(F.avg(c), places).alias(f"{c}_mean") for c in columns],
            *[F.bround(F.stddev_samp(c), places).alias(f"{c}_std") for c in columns],
        )
    )


def arm_report(df: DataFrame, value: str, arm: str = "allocation", unit: str = "joint_id") -> DataFrame:
    """Clusters, mean and sample SD of a value by arm, rounded half to even to whole numbers."""
    summary = rounded_summary(df, arm, [value], unit, places=0)
    return summary.toDF(arm, "clusters", "mean", "sd")
