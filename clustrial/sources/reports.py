"""Nested web-analytics reports: one JSON text per report page, flattened to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrial.functions import quoted
from clustrial.functions.periods import parse_compact_date

# The report format.
REPORT_SCHEMA = (
    "columnHeader STRUCT<dimensions: ARRAY<STRING>, "
    "metricHeader: STRUCT<metricHeaderEntries: ARRAY<STRUCT<name: STRING>>>>, "
    "data STRUCT<rows: ARRAY<STRUCT<dimensions: ARRAY<STRING>, "
    "metrics: ARRAY<STRUCT<values: ARRAY<STRING>>>>>, "
    "samplesReadCounts: ARRAY<STRING>, samplingSpaceSizes: ARRAY<STRING>>, "
    "nextPageToken STRING"
)


def _report(json: str) -> Column:
    return F.from_json(F.col(json), REPORT_SCHEMA)


def parse_number(text: Column, kind: str) -> Column:
    """Text to ``bigint`` or ``double``; empty text gives null, any other that does not fit
    the type an error, so that no value is lost unnoticed."""
    number = text.try_cast(kind)
    if kind == "bigint":
        number = F.when(~text.contains("."), number)
    wrong = (F.length(text) > 0) & number.isNull()
    message = F.concat(F.lit(f"not a {kind}: "), text)
    return F.when(wrong, F.raise_error(message).cast(kind)).otherwise(number)


def flatten_report(
    reports: DataFrame,
    dimensions: Sequence[str],
    metrics: Mapping[str, str],
    ranges: int = 1,
    json: str = "report",
    names: Sequence[str] = (),
    dedupe: bool = True,
) -> DataFrame:
    """One row per report row, one column per dimension and per metric and date range.

    ``metrics`` maps each metric name to ``bigint`` or ``double``; text that does not fit,
    and a row with more date ranges than ``ranges``, is an error. With several date
    ranges the columns are called ``<metric>_range_<i>``. Columns named ``ga:date*``
    become dates; ``names`` renames all columns by position. ``dedupe=False`` repeats
    every row once per metric and date range, as the original script did.

    All stored pages are read together, so following page tokens is a matter of
    pointing at the folder; ``unread_pages`` tells if the last page is missing.
    """
    parsed = reports.select(_report(json).alias("r"))
    rows = parsed.select(
        F.col("r.columnHeader.dimensions").alias("dimension_names"),
        F.col("r.columnHeader.metricHeader.metricHeaderEntries.name").alias("metric_names"),
        F.explode("r.data.rows").alias("row"),
    )
    too_many = F.size("row.metrics") > ranges
    message = F.concat(F.lit(f"more than {ranges} date ranges: "), F.size("row.metrics"))
    rows = rows.withColumn(
        "row", F.when(too_many, F.raise_error(message).cast(rows.schema["row"].dataType)).otherwise(F.col("row"))
    )

    def value_of(header: str, values: Column, name: str) -> Column:
        position = F.array_position(F.col(header), name).cast("int")
        return F.when(position > 0, F.try_element_at(values, position))

    columns = []
    for name in dimensions:
        column = value_of("dimension_names", F.col("row.dimensions"), name)
        if name.startswith("ga:date"):
            column = parse_compact_date(column)
        columns.append(column.alias(name))
    for i in range(ranges):
        values = F.try_element_at(F.col("row.metrics"), F.lit(i + 1)).getField("values")
        for name, kind in metrics.items():
            label = f"{name}_range_{i}" if ranges > 1 else name
            columns.append(
                parse_number(value_of("metric_names", values, name), kind).alias(label)
            )

    if not dedupe:
        copies = F.aggregate(
            F.transform("row.metrics", lambda m: F.size(m["values"])),
            F.lit(0),
            lambda total, size: total + size,
        )
        rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))
    flat = rows.select(*columns)
    return flat.toDF(*names) if names else flat


@dataclass(frozen=True)
class OpenReport:
    """The rows of a report under its own headers, and those that do not fit them."""

    rows: DataFrame
    rejected: DataFrame


def open_report(reports: DataFrame, json: str = "report", max_columns: int = 2_000) -> OpenReport:
    """Flatten reports by the headers they bring; no column has to be named.

    Columns are all dimensions, then all metrics for each date range, in the order in which
    headers name them; a report without one of them has null there. ``ga:date*`` become
    dates. A metric is ``bigint`` if all its values in all date ranges are whole, else
    ``double``; empty text is null. With several date ranges metric columns are called
    ``<metric>_range_<i>``. A metric called like a dimension gets a ``_``.

    A row is rejected if it has more or fewer dimensions or values than its header, no date
    range, a value that is no number or a date that is none; a whole text if it is not such
    a report. ``rejected`` has the other columns of ``reports``, ``reason``, and ``row``,
    the row or text as it came. Missing texts and reports without rows give nothing, and
    repeated rows stay.

    Headers and kinds of values are found by one aggregate over the rows, of which one line
    for each column passes through the driver; more than ``max_columns`` is an error.
    """
    carried = [c for c in reports.columns if c != json]
    parsed = reports.where(F.col(quoted(json)).isNotNull()).select(
        F.struct(*[F.col(quoted(c)) for c in carried]).alias("carried"), F.col(quoted(json)).alias("text"),
        F.from_json(F.col(quoted(json)), REPORT_SCHEMA).alias("r"),
    ).select(
        "carried", "text", F.col("r.data.rows").alias("rows"),
        F.col("r.columnHeader.dimensions").alias("dims"),
        F.col("r.columnHeader.metricHeader.metricHeaderEntries.name").alias("mets"),
    )
    headed = "dims IS NOT NULL AND mets IS NOT NULL AND NOT exists(dims, d -> d IS NULL) AND NOT exists(mets, m -> m IS NULL)"
    judged = parsed.where(headed).select(
        "carried", "dims", "mets", F.explode("rows").alias("row")
    ).withColumn("reason", F.expr(_MISFIT))
    good = judged.where("reason IS NULL")

    cells = good.selectExpr(
        "inline(concat(transform(dims, (d, i) -> named_struct('met', false, 'name', d, 'place', i, 'size', 0, 'broken', false)), "
        "transform(mets, (m, i) -> named_struct('met', true, 'name', m, 'place', i, 'size', size(row.metrics), "
        "'broken', exists(row.metrics, x -> length(get(x.values, i)) > 0 AND (contains(get(x.values, i), '.') OR try_cast(get(x.values, i) AS BIGINT) IS NULL))))))"
    )
    headers = (
        cells.groupBy("met", "name").agg(F.min("place").alias("place"), F.max("size").alias("ranges"), F.max("broken").alias("broken"))
        .orderBy("met", "place", "name").limit(max_columns + 1).collect()
    )
    if len(headers) > max_columns:
        raise ValueError(f"reports have more than {max_columns} columns")
    ranges = max([h["ranges"] for h in headers], default=0)

    def value_of(header: str, values: Column, name: str) -> Column:
        position = F.array_position(F.col(header), name).cast("int")
        return F.when(position > 0, F.try_element_at(values, position))

    columns = []
    for h in headers:
        if not h["met"]:
            column = value_of("dims", F.col("row.dimensions"), h["name"])
            column = parse_compact_date(column) if h["name"].startswith("ga:date") else column
            columns.append(column.alias(h["name"]))
    taken = {h["name"] for h in headers if not h["met"]}
    for i in range(ranges):
        values = F.try_element_at(F.col("row.metrics"), F.lit(i + 1)).getField("values")
        for h in headers:
            if h["met"]:
                label = f"{h['name']}_range_{i}" if ranges > 1 else h["name"]
                label += "_" * (label in taken)
                columns.append(parse_number(value_of("mets", values, h["name"]), "double" if h["broken"] else "bigint").alias(label))
    kept = [F.col("carried").getField(c).alias(c) for c in carried]
    rejected = judged.where("reason IS NOT NULL").select(*kept, "reason", F.to_json("row").alias("row"))
    unread = parsed.where(f"NOT coalesce({headed}, false)").select(*kept, F.lit("not a report").alias("reason"), F.col("text").alias("row"))
    return OpenReport(good.select(*columns), rejected.union(unread))


# Why a row does not fit its header, or null.
_MISFIT = """
    CASE WHEN coalesce(size(row.dimensions), -1) <> size(dims) THEN 'dimensions'
         WHEN coalesce(size(row.metrics), 0) <= 0
           OR exists(row.metrics, m -> coalesce(size(m.values), -1) <> size(mets)) THEN 'metrics'
         WHEN exists(row.metrics, m -> exists(m.values, v -> length(v) > 0 AND try_cast(v AS DOUBLE) IS NULL)) THEN 'number'
         WHEN exists(zip_with(dims, row.dimensions, (d, v) -> startswith(d, 'ga:date') AND length(v) > 0
                AND try_to_date(v, 'yyyyMMdd') IS NULL), x -> x) THEN 'date'
    END"""


def sampling_notice(reports: DataFrame, json: str = "report") -> DataFrame:
    """Per sampled report page, the share of rows read as a whole percent."""
    r = reports.withColumn("r", _report(json)).where(F.size("r.data.samplesReadCounts") > 0)
    read = F.element_at("r.data.samplesReadCounts", 1).cast("double")
    space = F.element_at("r.data.samplingSpaceSizes", 1).cast("double")
    return r.withColumn(
        "sampled_percent", F.bround(F.try_divide(read, space) * 100).cast("int")
    ).drop("r", json)


def unread_pages(reports: DataFrame, key: Sequence[str], json: str = "report") -> DataFrame:
    """Per report, the number of stored pages and whether its last page is among them."""
    last = F.coalesce(F.col("r.nextPageToken"), F.lit("")) == ""
    return (
        reports.withColumn("r", _report(json))
        .groupBy(*key)
        .agg(F.count("*").alias("pages"), F.max(last).alias("complete"))
    )
