"""Quality classifier: gated attention over the passages of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 512  # bytes
BLOCK = PASSAGE * 512  # bytes of passages whose features are held at once
PAIRS = 256  # buckets of byte pairs
TRIPLES = 1024  # buckets in which distinct byte triples are counted
WIDTH = 256 + PAIRS + 2
HIDDEN, GATE = 16, 8
THRESHOLD = 0.3


def passage_features(data: bytes) -> np.ndarray:
    """A row for each passage of ``PASSAGE`` bytes, the last one shorter.

    Square roots of the shares of bytes and of hashed byte pairs, the share of distinct
    byte triples (low where a passage repeats itself), and a constant.
    """
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    at = np.arange(len(b)) // PASSAGE
    n = int(at[-1]) + 1
    size = np.bincount(at, minlength=n).astype(np.float32)[:, None]

    def counted(values: np.ndarray, buckets: int) -> np.ndarray:
        found = np.bincount(at[: len(values)] * buckets + values, minlength=n * buckets)
        return found.reshape(n, buckets)

    pairs = (b[:-1] * 131 + b[1:]) * 2654435761 >> 12 & (PAIRS - 1)
    triples = (b[:-2] * 17161 + b[1:-1] * 131 + b[2:]) * 2654435761 >> 12 & (TRIPLES - 1)
    distinct = (counted(triples, TRIPLES) > 0).sum(axis=1, keepdims=True)
    shares = [np.sqrt(counted(b, 256) / size), np.sqrt(counted(pairs, PAIRS) / size)]
    return np.hstack([*shares, distinct / size, np.ones_like(size)]).astype(np.float32)


def text_bytes(text: str | None) -> bytes:
    """A missing or empty text is one passage with a line end."""
    return (text or "\n").encode("utf-8", "replace")


def _segments(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])


@dataclass
class AttentionModel:
    """tanh encoder, gated attention, and a logistic layer on the weighted mean passage."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # WIDTH x HIDDEN
    tanh_gate: np.ndarray  # HIDDEN x GATE
    sigmoid_gate: np.ndarray
    attend: np.ndarray  # GATE
    out: np.ndarray  # HIDDEN + 1

    def hidden(self, features: np.ndarray) -> np.ndarray:
        return np.tanh((features - self.mean) / self.scale @ self.encode)

    def pooled(self, hidden: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Attention weights, their inputs, and the mean passage of each run of rows from ``first``."""
        t, s = np.tanh(hidden @ self.tanh_gate), 1 / (1 + np.exp(-(hidden @ self.sigmoid_gate)))
        logit = (t * s) @ self.attend
        count = np.diff(np.r_[first, len(hidden)])
        weight = np.exp(logit - np.repeat(np.maximum.reduceat(logit, first), count))
        weight /= np.repeat(np.add.reduceat(weight, first), count)
        return weight, t, s, np.add.reduceat(weight[:, None] * hidden, first)

    def score(self, mean_passage: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(mean_passage @ self.out[:-1] + self.out[-1], -30, 30)))


def train(sample: pd.DataFrame, epochs: int = 40, batch: int = 128, rate: float = 0.01, seed: int = 7) -> AttentionModel:
    """Fit all layers together by Adam on the log loss of the documents' labels.

    ``sample`` has ``text`` and ``label``; without rows of both labels the model gives the
    share of label 1 to every text.
    """
    rng = np.random.default_rng(seed)
    data = [text_bytes(t) for t in sample["text"]]
    owner = np.repeat(np.arange(len(data)), [-(-len(d) // PASSAGE) for d in data])
    features = np.zeros((max(1, len(owner)), WIDTH), np.float32)
    done = 0
    for d in data:
        own = passage_features(d)
        features[done : done + len(own)] = own
        done += len(own)
    label = sample["label"].to_numpy(float)
    mean = features.mean(axis=0)
    scale = np.sqrt(np.maximum(0, np.einsum("ij,ij->j", features, features) / len(features) - mean**2)) + 0.01

    def start(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    model = AttentionModel(
        mean, scale, start(WIDTH, HIDDEN), start(HIDDEN, GATE), start(HIDDEN, GATE), start(GATE), np.zeros(HIDDEN + 1, np.float32)
    )
    share = (label.sum() + 1) / (len(label) + 2)
    model.out[-1] = np.log(share / (1 - share))
    if len(set(label)) < 2:
        return model
    names = ["encode", "tanh_gate", "sigmoid_gate", "attend", "out"]
    moment = {n: (np.zeros_like(getattr(model, n)), np.zeros_like(getattr(model, n))) for n in names}
    features -= mean
    features /= scale
    begins, ends = _segments(owner), np.r_[_segments(owner)[1:], len(owner)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            rows = np.concatenate([np.arange(begins[d], ends[d]) for d in docs])
            count = ends[docs] - begins[docs]
            first = np.r_[0, np.cumsum(count)[:-1]]
            x = features[rows]
            h = np.tanh(x @ model.encode)
            weight, t, s, pooled = model.pooled(h, first)
            error = (model.score(pooled) - label[docs])[:, None] / len(docs)
            grad = {"out": np.r_[(error * pooled).sum(axis=0), error.sum()]}
            to_pooled = np.repeat(error * model.out[:-1], count, axis=0)
            along = (to_pooled * h).sum(axis=1)
            to_logit = weight * (along - np.repeat(np.add.reduceat(weight * along, first), count))
            gate = to_logit[:, None] * model.attend
            to_t, to_s = gate * s * (1 - t * t), gate * t * s * (1 - s)
            grad["attend"] = (to_logit[:, None] * t * s).sum(axis=0)
            grad["tanh_gate"], grad["sigmoid_gate"] = h.T @ to_t, h.T @ to_s
            to_h = weight[:, None] * to_pooled + to_t @ model.tanh_gate.T + to_s @ model.sigmoid_gate.T
            grad["encode"] = x.T @ (to_h * (1 - h * h)) + 1e-5 * model.encode
            step += 1
            now = rate * min(1, 2 * (1 - epoch / epochs))
            for name in names:
                m, v = moment[name]
                m += 0.1 * (grad[name] - m)
                v += 0.01 * (grad[name] ** 2 - v)
                fixed = np.sqrt(v / (1 - 0.99**step)) + 1e-8
                getattr(model, name)[...] -= now * (m / (1 - 0.9**step)) / fixed
    return model


def score_texts(model: AttentionModel, texts: list[str | None]) -> np.ndarray:
    """The score of every whole text; features of one block of passages are held at a time."""
    hidden, owner = [], []
    for k, text in enumerate(texts):
        data = text_bytes(text)
        for a in range(0, len(data), BLOCK):
            h = model.hidden(passage_features(data[a : a + BLOCK]))
            hidden.append(h)
            owner.append(np.full(len(h), k))
    rows = np.concatenate(owner)
    return model.score(model.pooled(np.vstack(hidden), _segments(rows))[3])


def score_column(model: AttentionModel, text_column: str = "text") -> Column:
    """The score of the whole text, as a column; only the text goes to Python."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            pieces = [texts.iloc[k : k + 64] for k in range(0, len(texts), 64)]
            yield pd.Series(np.concatenate([score_texts(model, p.tolist()) for p in pieces]) if pieces else [], dtype=float)

    return score(F.col(text_column))


def classify(
    df: DataFrame, model: AttentionModel, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, score, predicted`` of every row, from its whole text, without a shuffle."""
    scored = df.select(F.col(id_column).alias("doc_id"), score_column(model, text_column).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
