"""Runs of repeated words: maximal stretches with a period, and texts without their repeats."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 24
MIN_PERIODS = 3
BLOCK_WORDS = 1 << 18  # of short texts that are worked on together
_PART = 1024
_MIX = 0x9E3779B97F4A7C15  # odd, 2**64 over the golden ratio
_WORD = (1 << 64) - 1


class _Positions:
    """The positions of a suffix class in order, in parts of bounded length."""

    __slots__ = ("heads", "parts", "size")

    def __init__(self, first: int):
        self.heads, self.parts, self.size = [first], [[first]], 1

    def add(self, x: int) -> tuple[int, int]:
        """Insert ``x``; the positions before and after it, or -1."""
        heads = self.heads
        k = max(bisect_left(heads, x) - 1, 0)
        part = self.parts[k]
        i = bisect_left(part, x)
        before = part[i - 1] if i else -1
        after = part[i] if i < len(part) else heads[k + 1] if k + 1 < len(heads) else -1
        insort(part, x)
        heads[k] = part[0]
        self.size += 1
        if len(part) > 2 * _PART:
            self.parts[k : k + 1] = [part[:_PART], part[_PART:]]
            heads[k : k + 1] = [part[0], part[_PART]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part


def _repeated(words: np.ndarray, text_of: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the texts in which some stretch of ``least`` words may occur twice.

    Equal stretches of a text have equal hashes, so no text with such a stretch is missed.
    """
    if len(words) < least:
        return np.empty(0, np.int64)
    mix = np.uint64(_MIX)
    h = (words.astype(np.uint64) + np.uint64(1)) * mix
    h ^= h >> np.uint64(29)
    size, factor = 1, _MIX
    while 2 * size <= least:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor & _WORD
        size *= 2
    if size < least:
        h = h[: size - least] * np.uint64(factor) + h[least - size :]
    h = (h ^ (h >> np.uint64(31)) ^ text_of[: len(h)].astype(np.uint64) * np.uint64(factor)) * mix
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    return np.unique(text_of[order[1:][same]])


def _suffix_ranks(first: np.ndarray) -> list[np.ndarray]:
    """For each k, ranks of all places by their first ``2 ** k`` words, until all differ.

    A rank is the number of places that sort before the class, so that classes are refined
    in place and only those with several members are sorted again.
    """
    n = len(first)
    active = np.arange(n)
    rank = np.zeros(n, np.int32)
    key, levels, step = first.astype(np.int64), [], 0
    while True:
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(key))
        start = np.maximum.accumulate(np.where(new, place, 0))
        old = rank[active]
        within = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        rank = rank.copy()
        rank[active] = old + (start - within)
        levels.append(rank)
        several = ~new | np.concatenate([~new[1:], [False]])
        active = active[several]
        if not len(active):
            return levels
        step = 2 * step or 1
        follow = np.where(active + step < n, rank[np.minimum(active + step, n - 1)].astype(np.int64), -1)
        key = rank[active].astype(np.int64) * (n + 1) + follow + 1
        by_rank = np.argsort(rank[active], kind="stable")
        active, key = active[by_rank], key[by_rank]


def _linked(first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order that share ``least`` words or more, and how many they share."""
    levels = _suffix_ranks(first)
    order = np.empty(len(first), np.int64)
    order[levels[-1]] = np.arange(len(first))
    a, b = order[:-1], order[1:]
    near = levels[min(least.bit_length() - 1, len(levels) - 1)]
    close = near[a] == near[b]
    a, b = a[close], b[close]
    shared = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        rank = levels[k]
        shared += np.where(rank[a + shared] == rank[b + shared], 1 << k, 0)
    enough = shared >= least
    return a[enough], b[enough], shared[enough]


def find_runs(first: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the runs in a sequence of numbers, its last one unique.

    Suffixes are united by decreasing common prefix. Where two places come to stand next to
    each other in the ordered class of both, and their distance p is at most their common
    prefix l, the stretch from the first to the end of the second's prefix has smallest
    period p: a smaller one would have put a place between them into the class before. It
    cannot grow to the right, and to the left only if the words before both places agree,
    which then is another pair's run. A run's first two period starts are such a pair.
    """
    least = -(-min_length * (min_periods - 1) // min_periods)
    least = max(least, 1)
    a, b, shared = _linked(first, least)
    by = np.argsort(-shared, kind="stable")
    before = np.concatenate([[-1], first[:-1]]).tolist()
    classes: dict[int, _Positions] = {}
    found = []
    for x, y, l in zip(a[by].tolist(), b[by].tolist(), shared[by].tolist()):
        large = classes.get(x) or _Positions(x)
        small = classes.get(y) or _Positions(y)
        if large.size < small.size:
            large, small, x, y = small, large, y, x
        classes[x] = large
        members = list(small)
        own = set(members) if len(members) > 1 else ()
        pairs = []
        for place in members:
            left, right = large.add(place)
            classes[place] = large
            if left >= 0 and left not in own:
                pairs.append((left, place))
            if right >= 0:
                pairs.append((place, right))
        # Members that came in later may stand between a member and its right neighbour.
        for k, (i, j) in enumerate(pairs):
            p = j - i
            if p > l or p + l < min_length or p + l < min_periods * p or (before[i] == before[j] and i):
                continue
            if own and i in own and k + 1 < len(pairs) and _between(members, i, j):
                continue
            found.append((i, p + l, p))
    return found


def _between(members: list[int], i: int, j: int) -> bool:
    """Whether a member lies between the places ``i`` and ``j``."""
    k = bisect_left(members, i + 1)
    return k < len(members) and members[k] < j


def _block(texts: list[list[bytes]], min_length: int, min_periods: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start and period."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    lengths = np.array([len(t) for t in texts], np.int64)
    words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(lengths.sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    text_of = np.repeat(np.arange(len(texts)), lengths)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    least = max(-(-min_length * (min_periods - 1) // min_periods), 1)
    busy = _repeated(words, text_of, least)
    if not len(busy):
        return runs
    # Words of different texts differ, and each text ends in a number of its own.
    n = len(number) + 1
    first = np.concatenate([np.append(words[starts[t] : starts[t + 1]], n - 1) + n * k for k, t in enumerate(busy)])
    begins = np.concatenate([[0], np.cumsum(lengths[busy] + 1)])
    for start, length, period in sorted(find_runs(first, min_length, min_periods)):
        k = int(np.searchsorted(begins, start, "right")) - 1
        runs[busy[k]].append((start - int(begins[k]), length, period))
    for found in runs:
        found.sort(key=lambda run: (run[0], run[2]))
    return runs


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside all repeats, the first period of a run staying unless another run drops it."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    keep = np.cumsum(depth[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def collapse_runs(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_length: int = MIN_LENGTH,
    min_periods: int = MIN_PERIODS,
) -> DataFrame:
    """``id_column``, ``text`` without repeats and ``runs``, an array of ``start, length, period``.

    A run is a stretch of consecutive words, split at ASCII white space, with smallest period
    ``period``, at least ``min_length`` words and ``min_periods`` (2 or more) periods long,
    that cannot be extended with that period; ``start`` counts words from 0. Runs come by
    start and period. A word is dropped if a run contains it after its first period; the
    others are joined by one space.

    Missing and empty texts have no words: an empty text and no runs. Ids may be missing or
    repeat; every row comes out once, on its own, and nothing is shuffled. A text must fit
    in memory with four bytes per word for each doubling of its longest repeat.
    """
    if min_periods < 2:
        raise ValueError("a run has two periods at least")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
            runs = _block(texts, min_length, min_periods)
            kept = [b" ".join(_kept(words, found)) for words, found in zip(texts, runs)]
            rows = [[dict(zip(("start", "length", "period"), run)) for run in found] for found in runs]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(kept, pa.binary()), pa.array(rows, run_type)], [id_column, "text", "runs"]
            )

        for batch in batches:
            ids, texts, size, first = [], [], 0, 0
            for i in range(batch.num_rows):
                words = (batch.column(1)[i].as_py() or b"").split()
                texts.append(words)
                size += len(words)
                if size >= BLOCK_WORDS or i + 1 == batch.num_rows:
                    yield done([batch.column(0).slice(first, i + 1 - first)], texts)
                    texts, size, first = [], 0, i + 1

    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    picked = df.select(F.col(id_column), F.col(text_column).cast("binary").alias("words"))
    kind = picked.schema[id_column].dataType.simpleString()
    found = picked.mapInArrow(
        work, f"`{id_column}` {kind}, text binary, runs array<struct<start:bigint,length:bigint,period:bigint>>"
    )
    return found.withColumn("text", F.col("text").cast("string"))


def planted(id_column: str, text_column: str) -> Column:
    """The text, or for every tenth id by its CRC-32 the text with repeats from some word on.

    With g a tenth of the hash and n words, word i from a = g mod n on becomes word
    a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). A missing id leaves the text as it is.
    """
    words = f"filter(split(`{text_column}`, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    h = f"crc32(cast(`{id_column}` as string))"
    again = (
        "transform(x.words, (w, i) -> if(i >= x.a, x.words[int(x.a + (i - x.a) % x.p)], w))"
    )

    def let(name: str, value: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    with_a = f"named_struct('words', v, 'g', {h} div 10, 'a', if(size(v) > 0, {h} div 10 % size(v), 0L))"
    with_p = "named_struct('words', y.words, 'a', y.a, 'p', 1 + (size(y.words) - y.a) div (3 + y.g % 8))"
    text = let("v", words, let("y", with_a, let("x", with_p, f"array_join({again}, ' ')")))
    return F.expr(f"if({h} % 10 = 0 and `{text_column}` is not null, {text}, `{text_column}`)")


def run_digests(df: DataFrame) -> DataFrame:
    """Per document: number of runs, the run of greatest exponent, and hashes of runs and collapsed text.

    ``df`` has ``doc_id`` and ``text``; see ``planted`` for what some texts become first. The
    run is the one of the greatest quotient of length and period, of the smallest start,
    then period, among equals; without runs its columns are null.
    """
    picked = df.select("doc_id", planted("doc_id", "text").alias("text"))
    found = collapse_runs(picked).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        F.expr(
            "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (best, r) -> "
            "if(best is null or r.length * best.period > best.length * r.period, r, best))"
        ).alias("best"),
        F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
