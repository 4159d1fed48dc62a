"""Near duplicates by SimHash: multi-index hashing over small Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrial.llm.components import components
from clustrial.llm.names import unused_name
from clustrial.sources.tables import store

SHINGLE = 3
MAX_BITS = 3
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the shingles of a text, 0 without words.

    A bit is set if it is set in over half of the XXH64 values of all shingles, repeats
    included; a text with fewer words than a shingle is one shingle.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = min(shingle, len(words)) - 1
    spans = zip(starts[: len(words) - last].tolist(), (ends[last:] - 1).tolist())
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[k : k + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def _text_hash(text_column: str) -> Column:
    return F.coalesce(F.sha2(F.col(f"`{text_column}`"), 256), F.lit("missing"))


def fingerprints(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``doc_id``, the hash ``text_hash`` of the text and its fingerprint ``fp`` as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(batch.column(1)[i].as_py(), shingle) for i in range(batch.num_rows)]
            signed = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), signed], ["doc_id", "text_hash", "fp"])

    picked = df.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), _text_hash(text_column).alias("text_hash")
    )
    return picked.mapInArrow(work, "doc_id long, text_hash string, fp long")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints (column ``fp``) with at most 3 differing bits.

    Two fingerprints within 3 bits have a half of 32 bits with at most one differing bit.
    So each fingerprint is filed under both halves, looks up the ball of radius one round
    each of its halves, and every match is verified on all 64 bits. Of two halves that
    differ in one bit only the one with the bit clear looks for the other.

    Spark takes the balls for as large as the fingerprints they are made from, of which each
    has some 35 rows there; so the join is told to merge, else it could broadcast them.
    """
    half = F.expr("shiftrightunsigned(fp, part * 32) & 4294967295L")
    parts = distinct.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    filed = parts.select("part", half.alias("half"), F.col("fp").alias("a"))
    balls = parts.select("part", half.alias("half"), F.col("fp").alias("b")).select(
        "part", "half", "b", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("bit")
    )
    flip = F.expr("shiftleft(1L, bit)")
    probes = balls.filter((F.col("bit") == 32) | (F.col("half").bitwiseAND(flip) == 0)).select(
        "part", F.when(F.col("bit") == 32, F.col("half")).otherwise(F.col("half") + flip).alias("half"), "b", "bit"
    )
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS) & (
        (F.col("bit") != 32) | (F.col("a") < F.col("b"))
    )
    return filed.alias("f").join(
        probes.hint("merge").alias("p"),
        (F.col("f.part") == F.col("p.part")) & (F.col("f.half") == F.col("p.half")) & near,
    ).select("a", "b")


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, node`` of every row.

    Documents whose fingerprints differ in at most 3 bits are linked; the component id is the
    smallest document id that links lead to. Rows with equal fingerprints, which hold all
    copies, are one node, so copies are never paired. Empty and missing texts have
    fingerprint 0. A missing id counts for no minimum; a component of such rows only has
    none. ``node`` names the component whatever its ids: where ids repeat, components may
    share a smallest id. Repeated rows come out as often as they go in.

    The last join is told to merge: copies leave few bytes in the stored fingerprints, so
    Spark could broadcast all rows.
    """
    stored = store(fingerprints(df, id_column, text_column, shingle), "fingerprints")
    nodes = store(stored.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = components(fingerprint_links(nodes.select("fp")))
    grouped = nodes.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    table = grouped.join(named, "component").select("fp", "component_id", F.col("component").alias("node"))
    return stored.join(table.hint("merge"), "fp").select("doc_id", "text_hash", "fp", "component_id", "node")


def one_of_each(df: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``df`` for each component of ``found``, what ``near_duplicates`` gives for it.

    It is the row of the smallest id, and of the smallest text hash among rows of that id;
    rows without id come last, so one of them stays only where no row has an id. Of rows
    equal in id and text any one stays.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = found.groupBy("node").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    name, mark = unused_name(df, "chosen_id"), unused_name(df, "chosen_hash")
    chosen = store(first.select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"), "n"), "chosen")
    named = df.withColumns({name: F.col(f"`{id_column}`").cast("long"), mark: _text_hash(text_column)})

    def of(rows: DataFrame) -> DataFrame:
        picked = rows.select(F.col("id").alias(name + "_"), F.col("hash").alias(mark + "_"))
        same = F.col(name).eqNullSafe(F.col(name + "_")) & (F.col(mark) == F.col(mark + "_"))
        return named.join(picked, same, "left_semi")

    alone = of(chosen.filter("n = 1"))
    one = of(chosen.filter("n > 1")).dropDuplicates([name, mark])
    return alone.union(one).drop(name, mark)
