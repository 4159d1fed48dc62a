"""The whole pipeline, and every query that has SQL, on the small tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from clustrial.checks.compare import connect, difference
from clustrial.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import AWKWARD, documents

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert pieces.select("doc_id").distinct().count() == counts[-1]


def test_awkward_rows_pass_every_stage(spark):
    docs = documents(spark, AWKWARD)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, SF_DIR), "stage")
    docs.count()
