"""Triangular factors of tall tables: one small matrix per task, merged in a tree.

The triangle R of a QR decomposition holds what a regression needs of its rows (R'R is
their matrix of products), and the triangle of several stacked triangles is that of all
their rows. Products are never formed, so the condition of the columns is not squared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.sources.tables import store

FAN_IN = 256  # factors of a group that meet in one task
HELD = 20_000  # groups whose factors a task holds before it hands them on

FACTOR_FIELDS = "part BIGINT, n BIGINT, rows ARRAY<DOUBLE>, steps ARRAY<DOUBLE>, first ARRAY<DOUBLE>, last ARRAY<DOUBLE>"


def triangle(rows: np.ndarray) -> np.ndarray:
    """A square R with R'R = rows'rows."""
    width = rows.shape[1]
    if len(rows) < width:
        rows = np.vstack([rows, np.zeros((width - len(rows), width))])
    return np.linalg.qr(rows, mode="r")


def _joined(held: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return triangle(rows if held is None else np.vstack([held, rows]))


class _Held:
    """What a task has seen of one group."""

    def __init__(self, key: tuple):
        self.key, self.n = key, 0
        self.rows = self.steps = self.first = self.last = None

    def add(self, values: np.ndarray, whole: bool, ordered: bool) -> None:
        if whole:
            self.rows = _joined(self.rows, np.column_stack([np.ones(len(values)), values]))
        if ordered:
            steps = np.diff(values if self.n == 0 else np.vstack([self.last, values]), axis=0)
            if len(steps):
                self.steps = _joined(self.steps, steps)
            self.first = values[0] if self.n == 0 else self.first
            self.last = values[-1]
        self.n += len(values)

    def row(self, part: int) -> tuple:
        arrays = (self.rows, self.steps, self.first, self.last)
        return (*self.key, part, self.n, *[None if a is None else a.ravel().tolist() for a in arrays])


def _task_factors(
    batches: Iterator[pd.DataFrame], by: Sequence[str], names: Sequence[str], whole: bool, ordered: bool
) -> Iterator[pd.DataFrame]:
    part, held = TaskContext.get().partitionId(), {}
    columns = [*by, "part", "n", "rows", "steps", "first", "last"]

    def out(groups) -> pd.DataFrame:
        return pd.DataFrame([g.row(part) for g in groups], columns=columns).astype({c: object for c in columns[-4:]})

    for batch in batches:
        values = batch[list(names)].to_numpy(float)
        codes = batch.groupby(list(by), sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(batch), int)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        for at in np.split(order, starts[1:]) if len(order) else ():
            key = tuple(batch[c].iat[at[0]] for c in by)
            if key not in held:
                held[key] = _Held(key)
            held[key].add(values[at], whole, ordered)
        if len(held) > HELD:
            # In sorted rows only the last group may go on; its rows must stay one piece.
            going_on = {key: held.pop(key)} if ordered else {}
            yield out(held.values())
            held = going_on
    if held:
        yield out(held.values())


def _merge(by: Sequence[str]):
    columns = [*by, "part", "n", "rows", "steps"]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {}
        for name in ("rows", "steps"):
            stacks = [np.reshape(a, (-1, width)) for a in pdf[name] if a is not None and (width := round(len(a) ** 0.5))]
            found[name] = triangle(np.vstack(stacks)).ravel().tolist() if stacks else None
        head = tuple(pdf[c].iat[0] for c in (*by, "part"))
        return pd.DataFrame([(*head, int(pdf["n"].sum()), found["rows"], found["steps"])], columns=columns)

    return merge


def factors(
    rows: DataFrame, names: Sequence[str], by: Sequence[str] = (), ordered: bool = False, whole: bool = True
) -> DataFrame:
    """Per group ``n`` and, row by row as flat arrays, the triangles ``rows`` and ``steps``.

    ``rows`` is that of a column of ones and the columns ``names`` (if ``whole``); ``steps``
    is that of the differences between neighbours, where ``rows`` lie in order by group
    (``ordered``), in partitions that follow each other: the ends of each partition are
    kept, and the steps over seams added. Values must not be null. Repeated rows count
    each; a group of one row has no steps, and an empty frame gives no rows. At most
    ``FAN_IN`` factors of a group meet in one task.
    """
    kinds = dict(rows.dtypes)
    keys = [f"`{c}` {kinds[c]}" for c in by]
    found = rows.select(*by, *names).mapInPandas(
        lambda batches: _task_factors(batches, by, names, whole, ordered), ", ".join([*keys, FACTOR_FIELDS])
    )
    found = store(found, "factors")
    if ordered:
        found = _with_seams(found, by, len(names))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    schema = ", ".join([*keys, "part BIGINT, n BIGINT, rows ARRAY<DOUBLE>, steps ARRAY<DOUBLE>"])
    found = found.select(*by, "part", "n", "rows", "steps")
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN))
        found = found.groupBy(*by, "part").applyInPandas(_merge(by), schema)
        parts = -(-parts // FAN_IN)
        if parts == 1:
            return found.drop("part")


def _with_seams(found: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """The step from the last row of one part to the first of the next, as one more row of steps.

    The window runs over one row for each part and group.
    """
    groups = f"PARTITION BY {', '.join(by)}" if by else ""
    seam = f"zip_with(first, lag(last) OVER ({groups} ORDER BY part), (a, b) -> a - b)"
    found = found.withColumn("seam", F.expr(seam))
    # A triangle stays a square: the seam is followed by rows of zeros.
    square = F.concat(F.col("seam"), F.array_repeat(F.lit(0.0), width * (width - 1)))
    extra = found.where("seam IS NOT NULL").select(
        *by, "part", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("array<double>").alias("rows"), square.alias("steps")
    )
    return found.select(*by, "part", "n", "rows", "steps").union(extra)
