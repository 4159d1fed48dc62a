"""Packing documents into sequences of a fixed length: bound-certified best fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.llm.tokens import crc32, default_tokenizer, encoded_rows
from clustrial.sources.tables import store, store_counted

GROUP_PIECES = 20_000  # pieces that one best-fit run takes
ROUNDS = 6
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    df: DataFrame,
    size: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """The ids of every text, an end id after each, cut where longer than ``size``.

    The first piece of a longer document takes what its full pieces leave over, so at most
    one piece of each document needs a partner. Missing texts are empty.
    """
    name = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, ids in encoded_rows(batches, name):
                edges = [0, *range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    yield key, k, a, b - a, crc32(ids[a:b]), ids[a:b] if with_ids else None

        held = []
        for row in rows():
            held.append(row)
            if len(held) == 2048:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        if with_ids:
            names.append("ids")
            arrays.append(pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names)

    picked = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(cut, _PIECE + (", ids array<int>" if with_ids else ""))


def lower_bound(counts: np.ndarray) -> int:
    """Fewest bins that pieces can need; ``counts[l]`` is the number of pieces of length l.

    The greatest of the bounds given by two families of dual feasible functions: rounding
    down to multiples of 1/k (k up to 32), and dropping pieces under a threshold while
    taking those over its complement as whole bins.
    """
    size = len(counts) - 1
    length = np.arange(size + 1, dtype=np.int64)
    n = counts.astype(np.int64)
    best = -(-int((n * length).sum()) // size)
    for k in range(1, 33):
        scaled = (k + 1) * length
        value = np.where(scaled % size == 0, k * length, size * (scaled // size))
        best = max(best, -(-int((n * value).sum()) // (k * size)))
    total = np.concatenate([[0], np.cumsum(n * length)])  # of lengths under the index
    many = np.concatenate([[0], np.cumsum(n)])
    cut = np.arange(1, size // 2 + 1)
    whole = many[-1] - many[size - cut + 1]
    middle = total[size - cut + 1] - total[cut]
    return max(best, int((whole + -(-middle // size)).max()))


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the free room of each bin.

    Longest first, each into the fullest bin that still has room for it.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r is set while some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        wide = open_rooms >> need
        if wide:
            free = need + (wide & -wide).bit_length() - 1
            b = by_room[free].pop()
            if not by_room[free]:
                open_rooms &= ~(1 << free)
        else:
            b, free = len(room), size
            room.append(size)
        bins[i], offsets[i] = b, size - free
        left = free - need
        room[b] = left
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def _packer(size: int, turn: int, final: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one group, and marks the pieces whose bin is not given up."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, size)
        given = room > 0
        if len(room) == lower_bound(np.bincount(lengths, minlength=size + 1)):
            given = np.arange(len(room)) == room.argmax()
        base = (turn << 56) + (int(pdf["_group"].iloc[0]) << 28)
        return pdf.drop(columns="_group").assign(
            sequence_id=base + bins, offset=offsets, _stays=final | ~given[bins]
        )

    return one


def pack(
    pieces: DataFrame,
    size: int = 1024,
    group_pieces: int = GROUP_PIECES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Give every piece a ``sequence_id`` and a gapless ``offset`` in a sequence of ``size``.

    Pieces are dealt at random into groups of about ``group_pieces``; each is packed by
    best-fit decreasing, and dual feasible functions give the fewest bins it could need.
    Full bins stay. A group that its bound certifies gives up only its emptiest bin, any
    other all bins with room; what is given up is dealt anew, in fewer groups, and packed
    again. This goes on until one group holds all that is left, or for ``rounds`` rounds.

    ``pieces`` has ``length`` and any other columns; each row is a piece of its own. Every
    length must lie in 1..size. The group size, not the data, bounds the memory of a task.
    """
    stored, n = store_counted(pieces, "pieces")
    alone = F.col("length") == size
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    done = [
        stored.filter(alone).withColumns(
            {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
        )
    ]
    columns = [*pieces.columns, "sequence_id", "offset"]
    left, n = stored.filter(~alone), max(1, n)
    for turn in range(1, rounds + 1):
        groups = max(1, -(-n // group_pieces))
        final = groups == 1 or turn == rounds

        spread = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups))
        packed = (
            left.withColumn("_group", spread)
            .groupBy("_group")
            .applyInPandas(_packer(size, turn, final), f"{fields}, sequence_id long, offset long, _stays boolean")
        )
        packed = store(packed, f"packed-{turn}")
        done.append(packed.filter("_stays").select(*columns))
        if final:
            break
        left = packed.filter("not _stays").select(*pieces.columns)
        n = left.count()
        if not n:
            break
    return reduce(DataFrame.union, [d.select(*columns) for d in done])


def pack_documents(
    df: DataFrame,
    size: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str | None = None,
) -> DataFrame:
    """All documents cut into pieces and packed.

    Repeated rows and ids are documents of their own; an empty table gives no rows.
    """
    return pack(cut_pieces(df, size, id_column, text_column, tokenizer), size)
