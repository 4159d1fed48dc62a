"""Named measures over a fact table: one scan for the whole registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrial.functions import has_keys, month_range, quoted, text

PRESCRIBING_SETTING = 4  # Fixed value: the setting code of a prescribing practice.


def explode_measures(df: DataFrame, registry: Mapping[str, str]) -> DataFrame:
    """One row per (input row, measure whose predicate holds), tagged ``measure``.

    A row matching several measures comes out once for each; a row matching none
    is dropped. Where the predicates only look at a code, apply this to the table
    of codes and join the fact to the result, so that predicates run once per code.
    """
    # Stated as one filter too, so that a short registry reaches the scan.
    df = df.where(F.expr(" OR ".join(f"({rule})" for rule in registry.values())))
    matches = ", ".join(
        f"CASE WHEN {rule} THEN {text(name)} END" for name, rule in registry.items()
    )
    return df.withColumn("measure", F.expr(f"explode(array({matches}))")).where(
        "measure IS NOT NULL"
    )


def prefix_measures(codes: DataFrame, rules: DataFrame, code: str = "bnf_code") -> DataFrame:
    """``code, measure``: the measures of each code, by rules on how codes begin.

    ``rules`` has ``measure``, ``prefix`` and, if some rules take codes out again, a boolean
    ``exclude``. A code has a measure if one of the measure's prefixes begins it and none of
    those that exclude. However many rules there are, each distinct code emits its prefixes
    once, of the lengths that rules have, and these are joined to the rules by equality.
    Missing codes, prefixes and measures match nothing; an empty prefix matches every code.
    """
    if "exclude" not in rules.columns:
        rules = rules.withColumn("exclude", F.lit(False))
    rules = rules.select("measure", "prefix", F.coalesce("exclude", F.lit(False)).alias("exclude"))
    rules = rules.where(has_keys(["measure", "prefix"])).distinct()
    # As many lengths as a code has characters at most.
    lengths = [row[0] for row in rules.select(F.length("prefix")).distinct().collect()]
    cut = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
    begins = (
        codes.select(F.col(quoted(code)).alias("code")).where("code IS NOT NULL").distinct()
        .select("code", F.explode(F.filter(cut, lambda n: n <= F.length("code"))).alias("n"))
        .select("code", F.expr("left(code, n)").alias("prefix"))
    )
    kept = begins.join(rules, "prefix").groupBy("code", "measure").agg(F.max("exclude").alias("out"))
    return kept.where("NOT out").select(F.col("code").alias(code), "measure")


def in_code_list(df: DataFrame, codes: DataFrame, column: str, code: str = "bnf_code") -> DataFrame:
    """Rows whose ``column`` is in the code list, each once however often it is listed."""
    return df.join(codes.select(F.col(code).alias(column)), column, "left_semi")


def _prescribing_practices(practices: DataFrame) -> DataFrame:
    return practices.where(f"setting = {PRESCRIBING_SETTING}").selectExpr(
        "code AS practice", "ccg_id AS pct_id"
    )


def region_denominators(
    statistics: DataFrame, practices: DataFrame, first: date, last: date
) -> DataFrame:
    """Thousands of patients by month and region: the dense grid of the measure table."""
    return (
        statistics.where(month_range("month", first, last))
        .join(_prescribing_practices(practices), "practice")
        .groupBy("month", "pct_id")
        .agg(F.expr("CAST(sum(total_list_size) AS DOUBLE) / 1000 AS denominator"))
    )


def practice_month_facts(prescribing: DataFrame) -> DataFrame:
    """``practice, month, measure, items, cost``, one row for each month and measure of a practice.

    What to save in buckets by practice: a practice holding a third of all facts is folded
    on the map side to a row for each of its months and measures.
    """
    return prescribing.groupBy("practice", "month", "measure").agg(
        F.expr("sum(items) AS items"), F.expr("sum(cost) AS cost")
    )


def region_month_measures(
    prescribing: DataFrame,
    statistics: DataFrame,
    practices: DataFrame,
    measures: list[str],
    first: date,
    last: date,
) -> DataFrame:
    """Items, cost and denominator by month, region and measure.

    ``prescribing`` has ``practice, month, measure, items, cost``. Every month and
    region with a denominator gets a row for every measure, zero where nothing was
    prescribed. Facts are summed per practice before the practice join: a practice
    holding a third of all rows is folded on the map side and never meets the join.
    """
    totals = [F.expr("sum(items) AS items"), F.expr("sum(cost) AS cost")]
    by_practice = (
        prescribing.where(month_range("month", first, last))
        .groupBy("practice", "month", "measure")
        .agg(*totals)
    )
    numerators = (
        by_practice.join(_prescribing_practices(practices), "practice")
        .groupBy("month", "pct_id", "measure")
        .agg(*totals)
    )
    grid = region_denominators(statistics, practices, first, last).withColumn(
        "measure", F.expr(f"explode(array({', '.join(text(m) for m in measures)}))")
    )
    return grid.join(numerators, ["month", "pct_id", "measure"], "left").selectExpr(
        "month",
        "pct_id",
        "measure",
        "coalesce(items, 0) AS items",
        "coalesce(cost, 0) AS cost",
        "denominator",
    )


def combine_measures(monthly: DataFrame) -> DataFrame:
    """All measures together by region and month.

    The denominator is the same in every measure's row of a region and month. A fact
    row belonging to several measures counts once for each.
    """
    return (
        monthly.where(has_keys(["pct_id", "month"]))
        .groupBy("pct_id", "month")
        .agg(
            F.expr("sum(items) AS items"),
            F.expr("sum(cost) AS cost"),
            F.expr("max(denominator) AS denominator"),
        )
    )


def months_between(first: date, last: date) -> list[date]:
    """The first days of all months from ``first`` to ``last``, both included."""
    count = (last.year - first.year) * 12 + last.month - first.month + 1
    months = [(first.year * 12 + first.month - 1 + i) for i in range(max(count, 0))]
    return [date(m // 12, m % 12 + 1, 1) for m in months]


def _stretches(months: Sequence[date]) -> list[tuple[date, date]]:
    """First and last month of every stretch without a gap."""
    stretches: list[tuple[date, date]] = []
    for month in months:
        if stretches and len(months_between(stretches[-1][1], month)) == 2:
            stretches[-1] = (stretches[-1][0], month)
        else:
            stretches.append((month, month))
    return stretches


def extend_month_table(
    spark: SparkSession,
    path: str,
    build: Callable[[date, date], DataFrame],
    first: date,
    last: date,
    renew: Iterable[date] = (),
) -> DataFrame:
    """Add the absent months to the month table at ``path``, and read the months asked for.

    ``build(first, last)`` makes the rows of a stretch of months, with a date column
    ``month``; it is called for absent months only, so facts of months already there are not
    scanned. Months are partitions: written ones replace their own partition and no other.
    ``renew`` names months to build again, say because facts came in late. A month without
    any rows leaves no partition and is tried again the next time.
    """
    wanted = months_between(first, last)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "month=*")) or []
    present = {date.fromisoformat(part.getPath().getName().removeprefix("month=")) for part in parts}
    again, reader = set(renew), spark.read
    for start, end in _stretches([m for m in wanted if m not in present or m in again]):
        built = build(start, end).where(month_range("month", start, end))
        reader = reader.schema(built.schema)  # nothing to infer it from where no month has rows
        # One task writes a month, unless adaptive execution splits a large one.
        built.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "month"
        ).parquet(path)
    return reader.parquet(path).where(month_range("month", first, last))
