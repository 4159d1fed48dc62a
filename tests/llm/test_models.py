"""Trained models: held-out accuracy, misspellings, and awkward rows."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest

from clustrial.llm import quality_mil, samples, toxicity
from clustrial.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, documents

SF_DIR = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@needs_tables
@pytest.mark.parametrize(
    ("name", "label", "least"), [("op8_attention_quality", "quality", 0.98), ("op2_subword_toxicity", "toxic", 0.95)]
)
def test_held_out_accuracy(spark, name, label, least):
    rows = QUERIES[name](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").toPandas()
    rows = rows[rows["held_out"]]
    assert (rows["predicted"] == rows[label]).mean() >= least
    assert rows["score"].between(0, 1).all()


def toxic_sample():
    rng = np.random.default_rng(0)
    plain = ["river", "stone", "garden", "winter", "market", "window", "simple", "morning"]
    texts = []
    for k in range(400):
        words = list(rng.choice(plain, 40))
        if k % 4 == 0:
            words[rng.integers(40)] = rng.choice(["scoundrel", "scoundrels", "worthless"])
        texts.append((" ".join(words), int(k % 4 == 0)))
    return pd.DataFrame(texts, columns=["text", "label"])


def test_unseen_misspellings_share_subwords():
    model = toxicity.train(toxic_sample(), epochs=20)
    assert model.score("river stone scoundrell garden") > 0.7 > model.score("river stone winter garden")
    assert model.score("market Worthles! window " + "morning " * 400) > 0.7


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 300)) for _ in range(120)]
    bad = [t[:900] + "### $$$ %%% " * 40 + t[900:] for t in good]
    sample = pd.DataFrame({"text": good[:100] + bad[:100], "label": [1] * 100 + [0] * 100})
    model = quality_mil.train(sample, epochs=15)
    assert (quality_mil.score_texts(model, good[100:]) > 0.5).all()
    assert (quality_mil.score_texts(model, bad[100:]) < 0.5).all()
    long = good[100] * 400  # several blocks of passages
    assert quality_mil.score_texts(model, [long])[0] > 0.5


@pytest.mark.parametrize("module", [toxicity, quality_mil])
@pytest.mark.parametrize("labels", [[], [1, 1, 1]])
def test_awkward_rows_and_samples(spark, module, labels):
    sample = pd.DataFrame({"text": ["some text"] * len(labels), "label": labels})
    found = module.classify(documents(spark, AWKWARD), module.train(sample)).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 for r in found)
    assert len({round(r.score, 6) for r in found}) == 1
    assert module.classify(documents(spark, AWKWARD).limit(0), module.train(sample)).count() == 0


def test_sample_is_bounded_and_skips_the_held_out_fold(spark):
    docs = documents(spark, [*[(k, f"text {k}") for k in range(300)], (5, "text 5"), (None, "x"), (400, "y" * 50)])
    labels = spark.createDataFrame(
        [*[(k, k % 2, 0) for k in range(300)], (5, 1, 1), (None, 1, 1), (7, None, None), (400, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    got = samples.labelled_texts(docs, labels, "quality", 5, 0, rows=50, chars=20)
    assert len(got) == 50 and got["doc_id"].is_unique
    import zlib

    assert all(zlib.crc32(str(i).encode()) % 5 for i in got["doc_id"])
    every = samples.labelled_texts(docs, labels, "quality", 5, 0, chars=20)
    assert 400 not in set(every["doc_id"]) and len(every) == sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(300))
