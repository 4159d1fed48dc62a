"""Descriptions, histograms and winsorising of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.functions import cap_at, has_keys, nan_as_missing, quoted
from clustrial.operators.positions import quantiles

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _melt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [
        F.struct(F.lit(c).alias("variable"), F.col(quoted(c)).cast("double").alias("value"))
        for c in columns
    ]
    return nan_as_missing(df.select(F.inline(F.array(*pairs))), ["value"])


def describe(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: dict[str, float] | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Count, mean, sample SD, minimum, quantiles and maximum; one row per column."""
    values = _melt(df, columns)
    moments = values.groupBy("variable").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    shares = quantiles(values, "value", probabilities or QUARTILES, ["variable"], accuracy)
    names = list(probabilities or QUARTILES)
    return moments.join(shares, "variable", "left").select(
        "variable", "count", "mean", "std", "min", *names, "max"
    )


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Counts of several columns in equal-width bins from minimum to maximum, empty bins included.

    One aggregate finds all spans, and one counts all bins. Spans are those of the finite
    values; an infinity counts in the first or last bin. A column without finite values has
    no bins. Two numbers per column pass through the driver.
    """
    values = _melt(df, columns)
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    spans = values.groupBy("variable").agg(F.min(finite).alias("low"), F.max(finite).alias("high"))
    bin_of, edges = [], []
    for name, low, high in spans.where("low IS NOT NULL").collect():
        low, high = (low, high) if low < high else (low - 0.5, high + 0.5)
        width = (high - low) / bins
        value = F.nanvl(F.col(quoted(name)).cast("double"), F.lit(None))
        place = F.least(F.floor((value - low) / width).cast("int"), F.lit(bins - 1))
        place = F.when(value <= low, 0).when(value >= high, bins - 1).when(value.isNotNull(), place)
        bin_of.append(F.struct(F.lit(name).alias("variable"), place.alias("bin")))
        edges += [
            F.struct(F.lit(name).alias("variable"), F.lit(i).alias("bin"), F.lit(low + i * width).alias("lower"), F.lit(low + (i + 1) * width).alias("upper"))
            for i in range(bins)
        ]
    if not edges:
        return df.sparkSession.createDataFrame([], "variable STRING, bin INT, lower DOUBLE, upper DOUBLE, n BIGINT")
    counts = (
        df.select(F.inline(F.array(*bin_of))).where("bin IS NOT NULL")
        .groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    grid = df.sparkSession.range(1).select(F.inline(F.array(*edges)))
    return grid.join(counts, ["variable", "bin"], "left").select(
        "variable", "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n")
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """The bins of one column; see ``histograms``."""
    return histograms(df, [column], bins).drop("variable")


def winsorise(
    df: DataFrame,
    columns: dict[str, str],
    probability: float = 0.95,
    accuracy: int | None = None,
) -> DataFrame:
    """Add each column capped at its own upper quantile over the whole frame.

    ``columns`` maps source to new column. A null becomes the cap. Only the caps,
    one number per column, pass through the driver.
    """
    caps = quantiles(
        _melt(df, list(columns)), "value", {"cap": probability}, ["variable"], accuracy
    )
    cap_of = {row["variable"]: row["cap"] for row in caps.collect()}
    return df.select(
        "*",
        *[
            cap_at(source, cap_of.get(source)).alias(name)
            for source, name in columns.items()
        ],
    )


def group_means(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    df = nan_as_missing(df, columns)
    return (
        df.where(has_keys([group])).groupBy(group).agg(*[F.avg(c).alias(c) for c in columns])
    )


def trimming_report(
    df: DataFrame, columns: dict[str, str], arm: str = "allocation", bins: int = 10
) -> dict[str, DataFrame]:
    """What winsorising did: descriptions and histograms of both forms, and arm means."""
    both = [*columns, *columns.values()]
    return {
        "describe": describe(df, both),
        "means": group_means(df, arm, list(columns.values())),
        "histograms": histograms(df, both, bins),
    }
