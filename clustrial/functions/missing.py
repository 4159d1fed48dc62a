"""Missing values and division, by the dataframe rules the trial was analysed with.

Arguments called ``str`` are columns or SQL expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name as SQL."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A text constant as SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def nan_as_missing(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN, which frames made from pandas hold for a missing number, turned into null."""
    named = None if columns is None else set(columns)
    floats = [c for c, kind in df.dtypes if kind in ("float", "double") and (named is None or c in named)]
    return df.withColumns({c: F.expr(f"nanvl({quoted(c)}, NULL)") for c in floats}) if floats else df


def has_keys(columns: Iterable[str]) -> Column:
    """True where no key is null: grouping leaves out rows with a null key."""
    return F.expr(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns) or "true")


def sum_or_zero(value: str) -> Column:
    """A sum that is 0, not null, when every value is null."""
    return F.expr(f"coalesce(sum({value}), 0)")


def ratio(numerator: str, denominator: str) -> Column:
    """A double quotient; null where the denominator is 0."""
    return F.expr(f"try_divide(CAST({numerator} AS DOUBLE), CAST({denominator} AS DOUBLE))")


def cap_at(value: str, cap: float | None) -> Column:
    """The value where it is below the cap, else the cap; null and NaN become the cap."""
    number, limit = F.col(value).cast("double"), F.lit(cap).cast("double")
    # NaN counts as greater than any number, so it becomes the cap as null does.
    return F.when(number < limit, number).otherwise(limit)


def indicator(value: str, mapping: dict[str, int]) -> Column:
    """Map labels to numbers; a label not in the mapping gives null."""
    cases = " ".join(f"WHEN {text(label)} THEN {number}" for label, number in mapping.items())
    return F.expr(f"CASE {value} {cases} END")
