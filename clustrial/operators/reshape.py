"""Long to wide: one row per unit, one column per value and label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.functions import has_keys, nan_as_missing, quoted, text


def flatten_names(df: DataFrame, strip: str = "_") -> DataFrame:
    """Strip joining characters left at either end of column names."""
    return df.toDF(*[name.strip(strip) for name in df.columns])


def pivot_sums(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    labels: Mapping[str, str],
    values: Sequence[str],
) -> DataFrame:
    """Sum ``values`` by key and label into columns ``<value>_<suffix>``.

    ``labels`` maps each label to its column suffix. Within a label nulls count as 0;
    a label the unit has no rows for stays null. Rows with a null key or label are
    dropped, so a unit without any data disappears. One aggregation, one shuffle.
    """
    df = nan_as_missing(df, [*keys, label, *values])
    return (
        df.where(has_keys([*keys, label]))
        .groupBy(*keys)
        .agg(
            *[
                F.expr(
                    f"sum(CASE WHEN {quoted(label)} = {text(name)} "
                    f"THEN coalesce({quoted(value)}, 0) END) AS {quoted(f'{value}_{suffix}')}"
                )
                for value in values
                for name, suffix in labels.items()
            ]
        )
    )


def pivot_dense(
    totals: DataFrame,
    units: Sequence[str],
    category: str,
    categories: Sequence[str],
    label: str,
    labels: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """One row per unit and category, zero where the unit has nothing of it.

    The unit's categories are aggregated side by side and then unrolled, so the grid
    needs no join of units with categories.
    """

    def cell(value: str, of: str, name: str) -> str:
        hit = f"{quoted(category)} = {text(of)} AND {quoted(label)} = {text(name)}"
        total = f"coalesce(sum(CASE WHEN {hit} THEN {quoted(value)} END), 0)"
        return f"{text(f'{value}_{name}')}, {total}"

    blocks = [
        ", ".join(
            [f"{text(category)}, {text(of)}", *[cell(v, of, n) for v in values for n in labels]]
        )
        for of in categories
    ]
    array = ", ".join(f"named_struct({block})" for block in blocks)
    totals = nan_as_missing(totals, [*units, *values])
    return (
        totals.where(has_keys([*units]))
        .groupBy(*units)
        .agg(F.expr(f"array({array}) AS _blocks"))
        .select(*units, F.inline("_blocks"))
    )
