"""The queries of this package on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrial.llm import brown, chat, html_text, manifest, packing, periodic_runs, pii, quality_mil, quality_rules
from clustrial.llm import samples, simhash, token_files, toxicity, winnowing


KEY = "pseudonym key of the checks"  # a real corpus has a secret of its own


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op2_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(samples.labelled_texts(docs, labels, "toxic", folds=3, held_out=1, rows=4_000))
    held_out = (samples.fold("doc_id", 3) == 1).alias("held_out")
    return toxicity.classify(docs, model).select("doc_id", held_out, "score", "predicted")


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(_table(spark, sf_dir, "documents"), KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii_found", lambda x: x["kind"]))), ",")
    return found.select(
        "doc_id", "text", F.size("pii_found").cast("long").alias("n_replaced"), kinds.alias("kinds")
    )


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"))
    return token_files.read_token_files(spark, folder, manifest)


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask_of(quality_rules.BASE_RULES))) != 0
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, base.alias("base_failed"), "kept")


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_mil.train(samples.labelled_texts(docs, labels, "quality", folds=5, held_out=0))
    held_out = (samples.fold("doc_id", 5) == 0).alias("held_out")
    return quality_mil.classify(docs, model).select("doc_id", held_out, "score", "predicted")


def op9_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered_proofs(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(_table(spark, sf_dir, "documents"))


def op13_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = brown.score_texts(_table(spark, sf_dir, "documents"), samples.fold("doc_id", 10) != 0)
    return scores.withColumn("held_out", ~F.col("trained")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES = {
    "op1_chat_snapshots": op1_chat_snapshots,
    "op2_subword_toxicity": op2_subword_toxicity,
    "op3_feistel_pseudonyms": op3_feistel_pseudonyms,
    "op4_winnowing": op4_winnowing,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_files": op6_token_files,
    "op7_rule_ledger": op7_rule_ledger,
    "op8_attention_quality": op8_attention_quality,
    "op9_layout_text": op9_layout_text,
    "op10_simhash": op10_simhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_brown_score": op13_brown_score,
}
ORACLES = {
    "op1_chat_snapshots": chat.ORACLE,
    "op7_rule_ledger": quality_rules.ORACLE,
    "op4_winnowing": winnowing.ORACLE,
    "op11_merkle_manifest": manifest.ORACLE,
}
