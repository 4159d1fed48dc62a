"""Exact distinct counts that merge: bitmaps of densely numbered members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.functions import has_keys, quoted
from clustrial.operators.positions import value_positions


def member_bitmaps(rows: DataFrame, member: str, by: Sequence[str]) -> DataFrame:
    """Columns ``by``, then ``bucket`` and ``members``, a bitmap of 32,768 members.

    The distinct members are numbered in order, in slices, and every group keeps a bitmap
    for each bucket of numbers it has a member in: at most as many bitmaps as distinct
    (group, member) pairs, of four kilobytes each before compression. Rows are made distinct
    on the map side first, so a member or group holding a third of them is folded early.
    Numbers hold within one table only: bitmaps of two calls must not be mixed. Missing
    members and groups are left out; an empty frame gives no rows; columns of ``by`` must
    not be called ``bucket`` or ``members``.
    """
    if {"bucket", "members"} & set(by):
        raise ValueError("group columns must not be called bucket or members")
    seen = rows.where(has_keys([*by, member])).select(*[F.col(quoted(c)) for c in by], F.col(quoted(member)).alias("_member"))
    seen = seen.distinct()
    places = value_positions(seen.select(F.col("_member").alias("value")).distinct(), "value")
    numbers = places.select(F.col("value").alias("_member"), (F.col("before") + 1).alias("_number"))
    numbered = seen.join(numbers, "_member").withColumn("bucket", F.bitmap_bucket_number("_number"))
    return numbered.groupBy(*[quoted(c) for c in by], "bucket").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("members")
    )


def distinct_members(bitmaps: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Exact number of distinct members of each group of ``by``, any columns of the bitmaps' rows.

    Bitmaps of a bucket are or-ed on the map side, then their bits are counted.
    """
    keys = [quoted(c) for c in by]
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("members").alias("members"))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("members")).alias(name))
