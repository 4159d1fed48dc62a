"""Bounded samples of labelled documents for training."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 20_000  # longer texts are scored but not trained on


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a missing id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held_out: int,
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> pd.DataFrame:
    """At most ``rows`` texts of at most ``chars`` characters, with their label 0 or 1.

    Rows of the fold ``held_out`` are left out. Ids are taken in the order of a hash, so the
    sample is the same in every run; only labels and ids are sorted for it. Of several rows
    or labels of an id, the greatest counts; missing texts, ids and labels are left out.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    known = known.select("doc_id", F.col(label).cast("int").alias("label"))
    near = known.join(docs.filter(F.length("text") <= chars).select("doc_id"), "doc_id", "left_semi")
    picked = near.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.filter(F.length("text") <= chars).select("doc_id", "text")
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    return found.toPandas().sort_values("doc_id").reset_index(drop=True)
