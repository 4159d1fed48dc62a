"""Names for working columns beside those a frame has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` starts with, whatever the case of its letters."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name
