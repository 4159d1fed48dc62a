"""Files, stored tables and nested reports."""

from __future__ import annotations

import json
from datetime import date

import pytest

from clustrial.sources import (
    SCHEMAS,
    append_all,
    flatten_report,
    open_report,
    read_csv,
    read_table,
    sampling_notice,
    save_bucketed,
    shared_folder,
    store,
    store_in_slices,
    unread_pages,
    write_csv,
    write_table,
)
from tests.conftest import rows


def test_csv_keeps_ids_and_doubled_quotes(spark, tmp_path):
    path = tmp_path / "teams.csv"
    path.write_text('ccg_id,joint_team\n01F,"""A, B and C team"""\n00D,Plain\n')
    df = read_csv(spark, str(path), SCHEMAS["teams"])
    assert rows(df) == [("00D", "Plain"), ("01F", '"A, B and C team"')]


def test_csv_drops_the_position_column_and_picks_columns(spark, tmp_path):
    path = tmp_path / "sizes.csv"
    path.write_text(",pct_id,list_size\n0,01F,5\n1,00D,\n")
    assert rows(read_csv(spark, str(path), SCHEMAS["list_sizes"])) == [("00D", None), ("01F", 5)]
    assert rows(read_csv(spark, str(path), SCHEMAS["list_sizes"], ["pct_id"])) == [("00D",), ("01F",)]


def test_all_schemas_parse(spark):
    for schema in SCHEMAS.values():
        assert spark.createDataFrame([], schema).columns


def test_written_tables_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, date(2018, 4, 1)), ("b", None, None)], "k STRING, v INT, d DATE")
    write_table(df, str(tmp_path / "t"), partition_by=["k"])
    assert rows(read_table(spark, str(tmp_path / "t"), columns=["k", "v"])) == [("a", 1), ("b", None)]
    write_csv(df, str(tmp_path / "c"))
    assert rows(read_csv(spark, str(tmp_path / "c"), df.schema)) == rows(df)


def test_append_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n INT, s STRING")
    b = spark.createDataFrame([("y", 2)], "s STRING, n INT")
    assert rows(append_all([a, b])) == [(1, "x"), (2, "y")]


def test_stored_tables_lie_in_the_shared_folder(spark):
    df = store(spark.range(5), "five")
    assert df.count() == 5
    assert shared_folder(spark) in df.inputFiles()[0]


def test_the_session_setting_names_the_shared_folder(spark, checkpoint_dir):
    assert shared_folder(spark) == checkpoint_dir


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_slices_are_ordered_and_split_a_hot_group(spark, many_slices):
    df = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 'hot' ELSE 'b' END AS g", "id")
    sliced = store_in_slices(df.repartition(7), ["g", "id"])
    spans = sliced.groupBy("_slice").agg({"g": "max", "id": "min"}).count()
    hot = sliced.where("g = 'hot'").groupBy("_slice").agg({"id": "count"}).collect()
    assert spans > 1 and len(hot) > 1
    edges = sliced.where("g = 'hot'").groupBy("_slice").agg(
        {"id": "max"}
    ).orderBy("_slice").collect()
    assert [r[1] for r in edges] == sorted(r[1] for r in edges)


def _report(rows_, ranges=1, token=None, sampled=False):
    data = {
        "rows": [
            {"dimensions": list(d), "metrics": [{"values": list(v)} for v in values]}
            for d, values in rows_
        ]
    }
    if sampled:
        data |= {"samplesReadCounts": ["499"], "samplingSpaceSizes": ["1000"]}
    report = {
        "columnHeader": {
            "dimensions": ["ga:date", "ga:pagePath"],
            "metricHeader": {
                "metricHeaderEntries": [{"name": "ga:pageviews"}, {"name": "ga:time"}]
            },
        },
        "data": data,
    }
    return json.dumps(report | ({"nextPageToken": token} if token else {}))


DIMENSIONS = ["ga:date", "ga:pagePath"]
METRICS = {"ga:pageviews": "bigint", "ga:time": "double"}


def test_report_pages_flatten_to_typed_rows(spark):
    one = _report([(("20181105", "/a"), [("3", "1.5")]), (("20181106", "/b"), [("", "2")])], token="x")
    two = _report([(("20181107", "/c"), [("7", "0.25")])])
    df = spark.createDataFrame([(one,), (two,)], "report STRING")
    out = flatten_report(df, DIMENSIONS, METRICS, names=["day", "page", "views", "time"])
    assert rows(out) == [
        (date(2018, 11, 5), "/a", 3, 1.5),
        (date(2018, 11, 6), "/b", None, 2.0),
        (date(2018, 11, 7), "/c", 7, 0.25),
    ]


def test_several_date_ranges_and_literal_repeats(spark):
    report = _report([((f"2018110{i}", "/a"), [("1", "2"), ("3", "4.5")]) for i in (1, 2, 3)])
    df = spark.createDataFrame([(report,)], "report STRING")
    out = flatten_report(df, DIMENSIONS, METRICS, ranges=2)
    assert out.columns == [
        "ga:date", "ga:pagePath",
        "ga:pageviews_range_0", "ga:time_range_0", "ga:pageviews_range_1", "ga:time_range_1",
    ]
    assert out.count() == 3
    assert rows(out)[0][2:] == (1, 2.0, 3, 4.5)
    assert flatten_report(df, DIMENSIONS, METRICS, ranges=2, dedupe=False).count() == 3 * 4


def test_sampling_and_missing_last_page(spark):
    full = _report([], token="p2")
    last = _report([], sampled=True)
    df = spark.createDataFrame(
        [("a", full), ("a", last), ("b", full)], "name STRING, report STRING"
    )
    assert rows(sampling_notice(df)) == [("a", 50)]
    assert rows(unread_pages(df, ["name"])) == [("a", 2, True), ("b", 1, False)]


def test_values_and_ranges_that_do_not_fit_are_errors(spark):
    half = spark.createDataFrame([(_report([(("20181105", "/a"), [("3.5", "1.5")])]),)], "report STRING")
    assert flatten_report(half, DIMENSIONS, dict.fromkeys(METRICS, "double")).first()[2] == 3.5
    for df, metrics, ranges in (
        (half, METRICS, 1),
        (spark.createDataFrame([(_report([(("20181105", "/a"), [("1", "2"), ("3", "4")])]),)], "report STRING"), METRICS, 1),
    ):
        with pytest.raises(Exception, match="not a bigint|more than 1 date ranges"):
            flatten_report(df, DIMENSIONS, metrics, ranges=ranges).collect()


def _text_report(dimensions, metrics, rows_):
    return json.dumps({
        "columnHeader": {"dimensions": dimensions, "metricHeader": {"metricHeaderEntries": [{"name": m} for m in metrics]}},
        "data": {"rows": [{"dimensions": d, "metrics": [{"values": v} for v in values]} for d, values in rows_]},
    })


def test_headers_give_the_columns_and_misfits_are_set_apart(spark):
    one = _text_report(["ga:date", "page"], ["hits", "page"], [
        (["20181105", "/a"], [["3", "1.5"]]), (["20181105", "/a"], [["3", "1.5"]]), (["20181106", "/b"], [["", "2"]]),
        (["20181106"], [["1", "2"]]), (["20181106", "/c"], [["1"]]), (["20181106", "/d"], [["x", "2"]]),
        (["20181199", "/e"], [["1", "2"]]), (["20181106", "/f"], []),
    ])
    two = _text_report(["page", "ga:date"], ["new"], [(["/g", "20181107"], [["99999999999999999999"]])])
    texts = [("k1", one), ("k2", two), ("k3", "{cut"), ("k4", None), ("k5", _text_report([], [], [])), ("k6", "{}")]
    found = open_report(spark.createDataFrame(texts, "reason STRING, report STRING").withColumnRenamed("reason", "key"))
    assert found.rows.dtypes == [("ga:date", "date"), ("page", "string"), ("hits", "bigint"), ("new", "double"), ("page_", "double")]
    first = (date(2018, 11, 5), "/a", 3, None, 1.5)
    assert rows(found.rows) == [first, first, (date(2018, 11, 6), "/b", None, None, 2.0), (date(2018, 11, 7), "/g", None, 1e20, None)]
    assert [(r.key, r.reason) for r in found.rejected.orderBy("key", "reason").collect()] == [
        ("k1", "date"), ("k1", "dimensions"), ("k1", "metrics"), ("k1", "metrics"), ("k1", "number"),
        ("k3", "not a report"), ("k6", "not a report"),
    ]
    assert found.rejected.where("key = 'k3'").first().row == "{cut"


def test_headers_of_several_ranges_and_of_nothing(spark):
    report = _text_report(["d"], ["m"], [(["a"], [["1"], ["2"]]), (["b"], [["3"]])])
    found = open_report(spark.createDataFrame([(report,)], "report STRING"))
    assert found.rows.columns == ["d", "m_range_0", "m_range_1"]
    assert rows(found.rows) == [("a", 1, 2), ("b", 3, None)]
    empty = open_report(spark.createDataFrame([], "report STRING, extra INT"))
    assert empty.rows.count() == 0 and empty.rejected.columns == ["extra", "reason", "row"] and empty.rejected.count() == 0
    with pytest.raises(ValueError, match="more than 1 columns"):
        open_report(spark.createDataFrame([(report,)], "report STRING"), max_columns=1)


def test_bucketed_tables_meet_without_a_shuffle(spark, checkpoint_dir):
    left = spark.range(500).selectExpr("id % 50 AS k", "id AS v")
    right = spark.range(60).selectExpr("id AS k", "id * 2 AS w")
    a, b = save_bucketed(left, "bucketed_a", ["k"], 4), save_bucketed(right, "bucketed_b", ["k"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.groupBy("k", "v").count().join(b, "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 500 and b.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert save_bucketed(left.limit(0), "bucketed_a", ["k"], 4).count() == 0
    for name in ("bucketed_a", "bucketed_b"):
        spark.sql(f"DROP TABLE {name}")
