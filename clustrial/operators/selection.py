"""Top units overall and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.operators.positions import add_rank


def top_units(
    df: DataFrame, by: str, unit: str, k: int, excluded: Sequence[str] = ()
) -> DataFrame:
    """The ``k`` units with the highest value, nulls last, ties in order of unit id."""
    kept = df.where(~F.col(unit).isin(*excluded)) if excluded else df
    return kept.orderBy(F.col(by).desc_nulls_last(), F.col(unit).asc_nulls_last()).limit(k)


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """Rows ranked ``k`` or better in their group, highest value first.

    Ties share a mean rank and nulls have none, so a group may give fewer or more
    than ``k`` rows.
    """
    ranked = add_rank(df, value, rank, group, ascending=False)
    return ranked.where(F.col(rank) <= k)
