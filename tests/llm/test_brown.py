"""The class-based language model against plain counting."""

from __future__ import annotations

import os
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrial.llm import brown, samples
from clustrial.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, documents

SF_DIR = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().translate(brown._LOWER).split(), b"\n"]


def trained(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def brute_scores(rows, class_of, classes):
    """Base and class scores from counted words and class bigrams of the training texts."""
    count = Counter(t for i, text in rows if trained(i) for t in tokens(text))
    total, kinds = sum(count.values()), len(count)
    mass, members, once, twice = Counter(), Counter(), 0, 0
    for word, n in count.items():
        mass[class_of[word]] += n
        members[class_of[word]] += 1
        once, twice = once + (n == 1), twice + (n == 2)
    off = once / (once + 2 * twice) if once and twice else 0.5
    unseen = [off * members[g] / mass[g] if mass[g] else 1.0 for g in range(classes)]
    flow = np.full((classes, classes), 0.1)
    for i, text in rows:
        if trained(i):
            of = [class_of[t] for t in tokens(text)]
            for a, b in zip([of[-1], *of], of):
                flow[a, b] += 1
    step = flow / flow.sum(axis=1, keepdims=True)
    out = []
    for i, text in rows:
        own, base, score, last = tokens(text), 0.0, 0.0, class_of.get(b"\n", 0)
        for t in own:
            base += log10((count[t] + 0.1) / (total + 0.1 * (kinds + 1)))
            if t in count:
                g = class_of[t]
                score += log10(step[last, g] * (count[t] - off) / mass[g])
            else:
                chance = [step[last, g] * unseen[g] for g in range(classes)]
                score, g = score + log10(sum(chance)), int(np.argmax(chance))
            last = g
        out.append((i, trained(i), len(own), sum(t in count for t in own), total, base, score))
    return sorted(out, key=lambda r: (str(r[0]), r[2], r[5]))


def compare(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("chunk_tokens", [60, 1 << 22])
def test_scores_same_as_plain_counting(spark, monkeypatch, chunk_tokens):
    kept = {}
    words = brown.word_classes
    monkeypatch.setattr(brown, "word_classes", lambda *a: kept.setdefault("classed", words(*a)))
    rows = [(i, f"the Cat{i % 7} sat on {'mat' * (i % 3)}. El gato{i % 11} come pan{i}\nfin" * (i % 4)) for i in range(150)] + AWKWARD
    training = samples.fold("doc_id", 10) != 0
    found = brown.score_texts(documents(spark, rows), training, classes=5, frequent=12, chunk_tokens=chunk_tokens)
    class_of = {bytes(r["word"]): r["class"] for r in kept["classed"].collect()}
    counts = Counter(t for i, text in rows if trained(i) for t in tokens(text))
    assert {bytes(r["word"]): r["n"] for r in kept["classed"].collect()} == counts
    compare(found.collect(), brute_scores(rows, class_of, 5))


def test_every_context_leads_to_probabilities_that_sum_to_one():
    rng = np.random.default_rng(3)
    step = np.log10(rng.dirichlet(np.ones(4), 4))
    n = [rng.integers(1, 9, 5) for _ in range(4)]
    off = 0.6
    for g in range(4):
        known = sum((10 ** step[g, h]) * ((n[h] - off) / n[h].sum()).sum() for h in range(4))
        unseen = sum((10 ** step[g, h]) * off * len(n[h]) / n[h].sum() for h in range(4))
        assert known + unseen == pytest.approx(1)


def likelihood(pairs, class_of, classes):
    flow = np.zeros((classes, classes))
    np.add.at(flow, (class_of[:, None], class_of[None, :]), pairs)
    return brown._flows(flow).sum() - 2 * brown._flows(flow.sum(axis=0)).sum()


def test_exchange_finds_the_classes_that_made_the_text():
    rng = np.random.default_rng(0)
    kind = np.arange(40) % 4
    text, g = [], 0
    for _ in range(40_000):
        g = (g + (1 if rng.random() < 0.9 else 2)) % 4
        text.append(int(rng.choice(np.flatnonzero(kind == g))))
    text = np.array(text)
    order = np.argsort(-np.bincount(text), kind="stable")
    text = np.argsort(order)[text]
    pairs = np.zeros((41, 41))
    np.add.at(pairs, (np.roll(text, 1), text), 1)
    class_of, flow = brown.exchange(pairs, 4)
    made = kind[order]
    assert all(len(set(class_of[made == k])) == 1 for k in range(4)) and len(set(class_of)) == 4
    assert flow[:4, :4].sum() == len(text) and np.allclose(flow, flow.round())
    assert likelihood(pairs[:40, :40], class_of, 4) >= likelihood(pairs[:40, :40], np.arange(40) % 4, 4)


def test_other_words_join_the_class_of_their_company(spark):
    """Rare words between words of two alternating kinds join the kind they stand for."""
    rows = [(i, " ".join(f"a{(i * k) % 5} b{(i + k) % 5}" for k in range(20)) + f" rareA{i % 9} b1 a1 rareB{i % 9} a2 b3") for i in range(200)]
    chunks = brown.encode(documents(spark, rows), "doc_id", "text", F.lit(True), 500)
    top = [w for w, _ in Counter(t for _, x in rows for t in tokens(x)).most_common(11)]
    class_of, flow = brown.exchange(brown.pair_counts(chunks, top), 3)
    frequent = dict(zip(top, class_of.tolist()))
    found = {bytes(r["word"]): r["class"] for r in brown.word_classes(chunks, frequent, flow).collect()}
    assert {found[f"rarea{k}".encode()] for k in range(9)} == {found[b"a2"]}
    assert {found[f"rareb{k}".encode()] for k in range(9)} == {found[b"b2"]}


def test_small_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert brown.score_texts(none, F.lit(True)).collect() == []
    untrained = brown.score_texts(documents(spark, AWKWARD), F.lit(None).cast("boolean")).collect()
    assert len(untrained) == len(AWKWARD)
    assert all((r.n_known, r.train_tokens, r.trained) == (0, 0, False) for r in untrained)
    assert [s for r in untrained for s in (r.base_score, r.score)] == pytest.approx([0.0] * 2 * len(AWKWARD), abs=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_texts_are_less_surprising_than_to_the_base(spark):
    rows = QUERIES["op13_brown_score"](spark, SF_DIR).filter("held_out").collect()
    assert rows and sum(r.score for r in rows) > 0.92 * sum(r.base_score for r in rows)
