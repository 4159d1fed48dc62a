"""Stored tables by content and owner, month tables extended in place, slices of any input."""

from __future__ import annotations

import os
import random
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clustrial.operators.measures import extend_month_table, months_between, prefix_measures
from clustrial.sources import TableStore, store
from clustrial.sources import tables
from tests.conftest import rows


def _leaves(df) -> list[str]:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    paths = [leaves.apply(i).relation().location().rootPaths() for i in range(leaves.length())]
    return [p.apply(i).toString() for p in paths for i in range(p.length())]


@pytest.fixture
def facts(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(100).selectExpr("id", "id % 7 AS k", "id * 2 AS v").write.parquet(path)
    return path


def _sums(spark, path, at_least=0):
    return spark.read.parquet(path).where(F.col("id") >= at_least).groupBy("k").agg(F.sum("v").alias("v"))


def test_the_same_question_is_read_from_its_table(spark, facts, tmp_path):
    folder = str(tmp_path / "kept")
    first = TableStore(spark, folder, keep=True).reuse(_sums(spark, facts), "sums")
    want = rows(_sums(spark, facts))
    written = sorted(os.listdir(folder))
    again = TableStore(spark, folder, keep=True).reuse(_sums(spark, facts), "sums")
    assert rows(first) == rows(again) == want and sorted(os.listdir(folder)) == written
    assert _leaves(again) == _leaves(first) and facts not in _leaves(again)[0]


def test_other_questions_and_other_files_get_other_tables(spark, facts, tmp_path):
    names = {tables.content_name(_sums(spark, facts, n)) for n in (0, 1)}
    read = spark.read.schema("v BIGINT, k BIGINT").parquet(facts)
    names |= {tables.content_name(read), tables.content_name(read.toDF("v", "kk")), tables.content_name(spark.read.parquet(facts).select("v", "k"))}
    names |= {tables.content_name(spark.read.schema("k BIGINT, v BIGINT").parquet(facts).select("v", "k"))}
    wide = spark.read.parquet(facts).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)])
    names |= {tables.content_name(wide), tables.content_name(wide.withColumn("c57", F.col("c57") + 99))}
    assert len(names) == 8 and None not in names
    before = tables.content_name(_sums(spark, facts))
    spark.range(1).selectExpr("id", "id AS k", "id AS v").write.mode("append").parquet(facts)
    assert tables.content_name(_sums(spark, facts)) != before
    store_ = TableStore(spark, str(tmp_path / "kept"), keep=True)
    assert rows(store_.reuse(_sums(spark, facts))) == rows(_sums(spark, facts))


def test_plans_that_do_not_tell_their_content_are_never_reused(spark, facts, tmp_path):
    plus = F.udf(lambda x: x + 1, "long")
    untold = [
        spark.createDataFrame([(1,)], "a INT"),
        spark.read.parquet(facts).withColumn("w", plus("id")),
        spark.read.parquet(facts).mapInPandas(lambda parts: parts, "id BIGINT, k BIGINT, v BIGINT"),
    ]
    assert [tables.content_name(df) for df in untold] == [None] * 3
    kept = TableStore(spark, str(tmp_path / "kept"), keep=True)
    assert [kept.reuse(untold[0]).count() for _ in range(2)] == [1, 1]
    assert len(os.listdir(tmp_path / "kept")) == 2


def test_an_unfinished_table_is_not_read(spark, facts, tmp_path):
    folder = tmp_path / "kept"
    name = tables.content_name(_sums(spark, facts))
    (folder / "_half-written").mkdir(parents=True)
    kept = TableStore(spark, str(folder), keep=True)
    assert kept.reuse(_sums(spark, facts), "sums").count() == 7
    assert sorted(p for p in os.listdir(folder) if not p.startswith("_")) == [f"sums-{name}"]


def test_closing_leaves_no_folder(spark, facts, checkpoint_dir):
    with TableStore(spark) as owned:
        inside = store(spark.read.parquet(facts), "plain")
        reused = owned.reuse(_sums(spark, facts), "sums")
        assert inside.count() == 100 and reused.count() == 7
        assert len(os.listdir(owned.folder.removeprefix("file:"))) == 2
    assert not os.path.exists(owned.folder.removeprefix("file:"))
    outside = store(spark.read.parquet(facts), "plain")
    assert owned.folder not in _leaves(outside)[0] and outside.count() == 100


def test_an_owner_deletes_only_what_it_wrote(spark, facts, tmp_path):
    folder = str(tmp_path / "shared")
    kept = TableStore(spark, folder, keep=True)
    kept.reuse(_sums(spark, facts), "sums")
    other = TableStore(spark, folder)
    other.reuse(_sums(spark, facts), "sums")
    other.reuse(_sums(spark, facts, 5), "sums")
    assert len(os.listdir(folder)) == 2
    other.close()
    kept.close()
    assert len(os.listdir(folder)) == 1
    kept.clear()
    assert not os.path.exists(folder)


def test_slices_follow_the_rows_whatever_the_input(spark, monkeypatch):
    """Local rows and RDDs have no known size; a table far larger than what comes of it has one too many."""
    monkeypatch.setattr(tables, "SLICE_ROWS", 10_000)
    pdf = pd.DataFrame({"v": range(45_000)})
    local = spark.createDataFrame(pdf)
    rdd = spark.createDataFrame(spark.sparkContext.parallelize([(i,) for i in range(45_000)]), "v INT")
    assert tables.input_bytes(rdd) > 1 << 60 > tables.input_bytes(tables.sized(rdd))
    for df in (local, rdd):
        spans = tables.store_in_slices(df, ["v"]).groupBy("_slice").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("a").collect()
        assert len(spans) == 5 and all(x.b < y.a and x._slice < y._slice for x, y in zip(spans, spans[1:]))
    few = spark.range(1 << 20).groupBy((F.col("id") % 3).alias("v")).count()
    assert tables.store_in_slices(few, ["v"]).select("_slice").distinct().count() == 1


def test_only_absent_months_are_built(spark, tmp_path):
    path, built = str(tmp_path / "months"), []

    def build(first, last):
        built.append((first, last))
        months = [m for m in months_between(first, last) if m.month != 4]
        return spark.createDataFrame([(m, m.month, "x") for m in months], "month DATE, n INT, pct_id STRING")

    def files():
        return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part")}

    march = extend_month_table(spark, path, build, date(2020, 2, 1), date(2020, 3, 1))
    assert rows(march, "month", "n") == [(date(2020, 2, 1), 2), (date(2020, 3, 1), 3)]
    old = files()
    all_ = extend_month_table(spark, path, build, date(2019, 12, 1), date(2020, 5, 1))
    assert [r[1] for r in rows(all_, "month", "n")] == [12, 1, 2, 3, 5]
    assert built == [(date(2020, 2, 1), date(2020, 3, 1)), (date(2019, 12, 1), date(2020, 1, 1)), (date(2020, 4, 1), date(2020, 5, 1))]
    assert old.items() <= files().items()
    built.clear()
    extend_month_table(spark, path, build, date(2020, 1, 1), date(2020, 3, 1), renew=[date(2020, 2, 1)])
    assert built == [(date(2020, 2, 1), date(2020, 2, 1))]
    now = files()
    assert {k for k in old if k not in now} == {k for k in old if "month=2020-02" in k[0]}
    none = extend_month_table(spark, str(tmp_path / "none"), build, date(2020, 4, 1), date(2020, 4, 1))
    assert none.count() == 0


def test_prefix_rules_equal_a_loop(spark):
    rnd = random.Random(2)
    codes = ["".join(rnd.choice("ab1") for _ in range(rnd.randint(0, 7))) for _ in range(400)] + [None]
    rules = [(f"m{rnd.randrange(6)}", "".join(rnd.choice("ab1") for _ in range(rnd.randint(0, 5))), rnd.random() < 0.3) for _ in range(40)]
    rules += [(None, "a", False), ("m0", None, False), ("m9", "b", None)]
    got = prefix_measures(
        spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "`the code` STRING, measure INT"),
        spark.createDataFrame(rules, "measure STRING, prefix STRING, exclude BOOLEAN"), "the code",
    )
    want = set()
    for code in set(codes) - {None}:
        for measure in {m for m, _, _ in rules if m}:
            hits = [bool(out) for m, p, out in rules if m == measure and p is not None and code.startswith(p)]
            if hits and not any(hits):
                want.add((code, measure))
    assert set(rows(got)) == want and got.count() == len(want)
    assert got.columns == ["the code", "measure"]


def test_thousands_of_prefix_rules_are_one_equal_join(spark):
    codes = spark.range(50_000).selectExpr("lpad(cast(id AS STRING), 6, '0') AS bnf_code")
    rules = spark.range(3_000).selectExpr("concat('m', id) AS measure", "lpad(cast(id AS STRING), 4, '0') AS prefix")
    found = prefix_measures(codes, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 3_000 * 100 - 250_000
