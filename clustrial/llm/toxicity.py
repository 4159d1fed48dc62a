"""Toxicity: averaged subword embeddings under a linear softmax."""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
SPAN = 2  # words whose subwords are averaged
SHARPNESS = 10.0
MIN_DOCS = 10  # training documents that a subword must be in to be learned
THRESHOLD = 0.7
MAX_WORDS = 500_000  # margins a worker remembers; beyond that they are worked out again
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def subwords(word: str) -> list[int]:
    """Buckets of a word and its character n-grams, in lower case, without outer punctuation."""
    w = "<" + _EDGES.sub("", word.lower()) + ">"
    if len(w) == 2:
        return []
    grams = {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)}
    grams.add(w)
    return sorted(zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams)


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return first, np.diff(np.r_[first, len(owner)])


def pooled(span_margin: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's smooth maximum over its spans, log mean exp, and the spans' shares in it."""
    top = np.maximum.reduceat(span_margin, first)
    share = np.exp(span_margin - np.repeat(top, count))
    total = np.add.reduceat(share, first)
    return top + np.log(total / count), share / np.repeat(total, count)


class SubwordModel(dict):
    """Embeddings and output layer; as a dict, the margins of words met so far.

    The margin of a word is the difference of the two logits that the mean embedding of its
    subwords gives. A word never seen in training has the subwords it shares with others.
    """

    def __init__(self, embeddings: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.embeddings, self.output, self.bias = embeddings, output, bias
        self.of_bucket = SHARPNESS * (embeddings @ (output[:, 1] - output[:, 0]))

    def __missing__(self, word: str) -> float:
        plain = _EDGES.sub("", word.lower())
        margin = self.get(plain)
        if margin is None:
            parts = subwords(plain)
            margin = float(self.of_bucket[parts].mean()) if parts else 0.0
        if len(word) <= 100:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = self[plain] = margin
        return margin

    def __reduce__(self):
        return SubwordModel, (self.embeddings, self.output, self.bias)

    def score(self, text: str | None) -> float:
        """Probability of label 1 from all words; a text without words has the bias alone."""
        words = (text or "").split()
        margin = np.fromiter(map(self.__getitem__, words), float, len(words)) if words else np.zeros(1)
        spans = np.add.reduceat(margin, np.arange(0, len(margin), SPAN))
        size = np.full(len(spans), float(SPAN))
        size[-1] = len(margin) - SPAN * (len(spans) - 1)
        z = pooled(spans / size, np.array([0]), np.array([len(spans)]))[0][0] + self.bias[1] - self.bias[0]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(sample: pd.DataFrame, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 1) -> SubwordModel:
    """Fit embeddings and softmax layer together by Adam over all of ``sample`` (text, label).

    Without rows of both labels every text gets the share of label 1.
    """
    rng = np.random.default_rng(seed)
    label = sample["label"].to_numpy(float)
    share = (label.sum() + 1) / (len(label) + 2)
    bias = np.log(np.array([1 - share, share]))
    embeddings = 0.01 * rng.standard_normal((BUCKETS, DIM))
    output = np.tile([-0.35, 0.35], (DIM, 1)) + 0.1 * rng.standard_normal((DIM, 2))
    if len(set(label)) < 2:
        return SubwordModel(np.zeros_like(embeddings), output, bias)
    # Flat arrays of small numbers: the driver holds the sample and little more.
    vocabulary: dict[str, int] = {}
    bucket, parts, word, size, doc = (array("i") for _ in range(5))
    for d, text in enumerate(sample["text"]):
        words = text.split() or [""]
        for w in words:
            if w not in vocabulary:
                vocabulary[w] = len(vocabulary)
                found = subwords(w) or [BUCKETS]  # a bucket that is never learned
                bucket.extend(found)
                parts.append(len(found))
            word.append(vocabulary[w])
        spans = -(-len(words) // SPAN)
        size.extend([SPAN] * (spans - 1) + [len(words) - SPAN * (spans - 1)])
        doc.extend([d] * spans)
    vocabulary.clear()
    bucket, parts, word, size, doc = (np.frombuffer(a, np.int32) for a in (bucket, parts, word, size, doc))
    begin_word = np.r_[0, np.cumsum(parts)[:-1]]
    begin_span = np.r_[0, np.cumsum(size)[:-1]]
    first, count = _runs(doc)
    met = np.unique(np.repeat(doc.astype(np.int64), size) * len(parts) + word) % len(parts)
    in_docs = np.bincount(met, minlength=len(parts))
    del met
    learned = np.bincount(bucket, np.repeat(in_docs, parts), BUCKETS + 1)[:BUCKETS] >= MIN_DOCS
    embeddings *= learned[:, None]
    weights = [embeddings, output, bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, epochs + 1):
        along = output[:, 1] - output[:, 0]
        of_bucket = np.append(SHARPNESS * (embeddings @ along), 0).astype(np.float32)
        of_words = np.add.reduceat(of_bucket[bucket], begin_word) / parts
        of_span = np.add.reduceat(of_words[word], begin_span) / size
        z, attention = pooled(of_span, first, count)
        error = (1 / (1 + np.exp(-(z + bias[1] - bias[0]))) - label) / len(label)
        to_span = np.repeat(error, count) * attention / size
        to_word = np.bincount(word, np.repeat(to_span, size), len(parts)) / parts
        to_bucket = np.bincount(bucket, np.repeat(to_word, parts), BUCKETS + 1)[:BUCKETS] * SHARPNESS * learned
        to_along = embeddings.T @ to_bucket
        total = error.sum()
        gradients = [
            np.outer(to_bucket, along) + decay * embeddings,
            np.stack([-to_along, to_along], axis=1),
            np.array([-total, total]),
        ]
        for value, gradient, (m, v) in zip(weights, gradients, moments):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return SubwordModel(embeddings, output, bias)


_MODELS: dict[str, SubwordModel] = {}


def _shared_model(name: str, weights: tuple) -> SubwordModel:
    """One model for each worker process, so that its words stay known between tasks."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = SubwordModel(*weights)
    return _MODELS[name]


def classify(
    df: DataFrame, model: SubwordModel, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, score, predicted`` of every row, from its whole text, without a shuffle.

    The model, whose size is fixed, is broadcast once.
    """
    name = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast((model.embeddings.astype(np.float32), model.output, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shared_model(name, shared.value)
        for batch in batches:
            score = np.array([own.score(batch.column(1)[i].as_py()) for i in range(batch.num_rows)], float)
            predicted = pa.array((score >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), predicted], ["doc_id", "score", "predicted"])

    picked = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(work, "doc_id long, score double, predicted int")
