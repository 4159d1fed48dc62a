"""The documents of a corpus, from raw rows to packed sequences.

Each stage takes all rows its predecessor kept and returns the columns of documents, the
last one the pieces of packed sequences. Extra columns of documents are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrial.llm import packing, pii, quality_mil, samples, simhash, winnowing
from clustrial.llm.queries import KEY
from clustrial.sources.tables import store

ORACLE_SQL = None  # tokens and a trained model cannot be stated in SQL


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_mil.train(samples.labelled_texts(docs, labels, "quality", folds=5, held_out=0))
    return docs.filter(quality_mil.score_column(model) >= quality_mil.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id; ids may be missing or repeat."""
    return simhash.one_of_each(docs, simhash.near_duplicates(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return winnowing.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms, the number of characters brought up to date."""
    found = pii.pseudonymise(docs, KEY, found_column="_found").drop("_found")
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("pii", pseudonymised),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
