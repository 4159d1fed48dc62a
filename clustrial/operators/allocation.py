"""Reproducible randomisation of units into two balanced arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrial.operators.positions import add_rank


def seeded_draw(unit: str, seed: int) -> Column:
    """A draw that depends on seed and id alone, not on partitioning or row order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(unit)))


def arms(ranked: DataFrame) -> DataFrame:
    """Even allocation ranks are control (``con``), odd ones ``I``."""
    code = F.col("allocation_ranking") % 2
    return ranked.withColumn("allocation_code", code).withColumn(
        "allocation", F.when(code == 0, "con").otherwise("I")
    )


def allocate(
    units: DataFrame, seed: int | None = None, unit: str = "joint_id", draw: str | None = None
) -> DataFrame:
    """Rank one draw per unit, and split the ranks into two arms.

    Give a ``seed``, or name a column with ``draw`` to replay stored draws of an earlier
    trial. Units may be of any number.
    """
    if draw is None:
        if seed is None:
            raise ValueError("a seed or a column of draws is needed")
        draw = "draw"
        units = units.withColumn(draw, seeded_draw(unit, seed))
    return arms(add_rank(units, draw, "allocation_ranking"))
