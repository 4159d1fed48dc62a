"""Chat formatting: cumulative snapshots collapsed, maximal conversations rendered."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrial.sources.tables import store

START, END = "<|im_start|>", "<|im_end|>"


def _turns(df: DataFrame) -> DataFrame:
    """The turns; ``own`` sets a turn without conversation id apart from all others."""
    turns = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    told = F.concat_ws("|", F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.length("role"), "role", "text")
    return turns.withColumn("own", F.when(F.col("conv_id").isNull(), F.sha2(told, 256)))


def prefix_hashes(df: DataFrame) -> DataFrame:
    """``conv_id, own, n, prefix, whole``: the hash of the first ``n`` turns, for every n.

    Each hash is that of the one before it, the role and the text of the turn, so equal
    hashes mean equal turns from the start on. ``whole`` marks the hash of all turns.
    Turns stream through in order, only as digests; a task holds one of them at a time.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, n, prefix = None, None, 0, b""
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row == seen:
                    continue
                conv, own, _, role, digest = row
                same = seen is not None and seen[:2] == (conv, own)
                if last is not None:
                    out.append((*last, not same))
                n, prefix = (n + 1, prefix) if same else (1, b"")
                prefix = blake2b(f"{len(role)} {role}{digest}".encode("utf-8", "replace") + prefix, digest_size=16).digest()
                last, seen = (conv, own, n, prefix.hex()), row
            yield table(out)
        if last is not None:
            yield table([(*last, True)])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        columns = list(zip(*rows)) or [[]] * 5
        names = ["conv_id", "own", "n", "prefix", "whole"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    order = ["conv_id", "own", "turn", "role", "digest"]
    turns = _turns(df).withColumn("digest", F.sha2("text", 256)).select(*order)
    return (
        turns.repartition("conv_id", "own").sortWithinPartitions(*order)
        .mapInArrow(chain, "conv_id long, own string, n long, prefix string, whole boolean")
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """``conv_id, own, n_turns, n_copies`` of conversations that prefix no longer one.

    Equal conversations are one, under their smallest id, if any has one. Prefixes of longer
    conversations are made distinct on the map side before the anti-join, so a first turn
    that a third of all conversations share is one row there.
    """
    whole = hashes.filter("whole").groupBy("prefix", F.col("n").alias("n_turns")).agg(
        F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "own")).alias("first"), F.count(F.lit(1)).alias("n_copies")
    )
    proper = hashes.filter("not whole").select("prefix").distinct()
    kept = whole.join(proper, "prefix", "left_anti")
    return kept.select("first.conv_id", "first.own", "n_turns", "n_copies")


def render(df: DataFrame, kept: DataFrame) -> DataFrame:
    """The conversations of ``kept`` as ChatML, its columns beside ``text``.

    Turns come in order of turn, role and the hash of the text; a repeated row counts once.
    A ``<|`` in a role or text is set apart, so that no content can pass for a marker.
    """

    def plain(column: str) -> Column:
        return F.replace(F.col(column), F.lit("<|"), F.lit("< |"))

    turns = _turns(df)
    # The key spreads turns without id, which have no number but a hash.
    key = F.coalesce(F.col("conv_id").cast("string"), "own").alias("key")
    one = turns.select("*", key).join(kept.select(key), "key", "left_semi")
    said = F.concat(F.lit(START), plain("role"), F.lit("\n"), plain("text"), F.lit(END + "\n"))
    parts = F.collect_set(F.struct("turn", "role", F.sha2("text", 256).alias("digest"), said.alias("said")))
    texts = one.groupBy("key").agg(F.array_sort(parts).alias("parts")).select(
        "key", F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("text")
    )
    return kept.select("*", key).join(texts, "key").drop("key", "own")


def format_chats(df: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, text`` of every maximal conversation.

    ``df`` has ``conv_id, turn, role, text``. A missing role is ``unknown``, a missing text
    empty, and a turn without conversation id is a conversation of its own, equal rows of it
    one and the same. Repeated rows count once. A rendered conversation is one row, so its
    turns must fit in memory together; nothing else is gathered by conversation. An empty
    table gives no rows.
    """
    hashes = store(prefix_hashes(df), "prefixes")
    return render(df, store(maximal(hashes), "maximal"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, sha256(text)) AS t
  FROM t GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN struct_pack(turn, role, text) END),
u AS (SELECT t, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY t)
SELECT conv_id, CAST(len(t) AS BIGINT) AS n_turns, n_copies,
  array_to_string(list_transform(t, lambda x: '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10)
    || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM u
WHERE NOT EXISTS (
  SELECT 1 FROM u AS b WHERE b.t[1] = u.t[1] AND len(b.t) > len(u.t) AND b.t[1 : len(u.t)] = u.t)
"""
