"""Brown class-based language model: words exchanged between classes, texts scored by class bigrams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrial.sources.tables import store

END = b"\n"  # the end of a text; no word holds it
CLASSES = 48
FREQUENT = 1024  # words that are exchanged one by one before all others
PASSES = 10  # over the frequent words at most
CHUNK_TOKENS = 1 << 22
ALPHA = 0.1  # added to counts of words, and of class bigrams
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ENTRY = np.dtype([("context", "<u2"), ("n", "<u4")])
_ROWS = 1 << 16


def _flows(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


# --- chunks ------------------------------------------------------------------------


def encode(df: DataFrame, id_column: str, text_column: str, training: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Texts as numbers of the words of their chunk, stored.

    A chunk is a row with some consecutive texts of a task, up to ``chunk_tokens`` tokens and
    the last text: ids, training flags and lengths of its texts; ``tokens``, all its tokens
    as numbers; and ``words``, its distinct words by number. Word 0 is the end of a text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress

        def start() -> tuple[dict[bytes, int], list, list[bool], list[np.ndarray]]:
            numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
            numbers[END]
            return numbers, [], [], []

        def done() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            row = {
                "chunk": [(TaskContext.get().partitionId() << 24) + made], "ids": pa.array([ids], pa.list_(id_type)),
                "trained": [flags], "lengths": [[len(p) for p in parts]],
                "tokens": [pack(tokens.astype("<u4").tobytes())], "words": [pack(END.join(list(numbers)[1:]))],
            }
            return pa.RecordBatch.from_pydict(row)

        made, size = 0, 0
        numbers, ids, flags, parts = start()
        for batch in batches:
            id_type = batch.column(0).type
            for key, text, flag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = (text.as_py() or b"").translate(_LOWER).split()
                words.append(END)
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                ids.append(key)
                flags.append(bool(flag))
                size += len(words)
                if size >= chunk_tokens:
                    yield done()
                    made, size = made + 1, 0
                    numbers, ids, flags, parts = start()
        if parts:
            yield done()

    picked = df.select(
        F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("flag")
    )
    kind = picked.schema["id"].dataType.simpleString()
    schema = f"chunk bigint, ids array<{kind}>, trained array<boolean>, lengths array<bigint>, tokens binary, words binary"
    return store(picked.mapInArrow(work, schema), "language-chunks")


@dataclass
class _Chunk:
    number: int
    ids: pa.Array
    trained: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    words: list[bytes]

    def in_training(self) -> np.ndarray:
        """The tokens of the training texts; each text starts after the end of another."""
        return self.tokens[np.repeat(self.trained, self.lengths)]


def _chunks(batch: pa.RecordBatch) -> Iterator[_Chunk]:
    unpack = zstandard.ZstdDecompressor().decompress
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i] for name in batch.schema.names}
        words = unpack(row["words"].as_py())
        yield _Chunk(
            row["chunk"].as_py(), row["ids"].values, np.array(row["trained"].as_py(), bool), np.array(row["lengths"].as_py(), np.int64),
            np.frombuffer(unpack(row["tokens"].as_py()), "<u4"), [END, *(words.split(END) if words else [])],
        )


def _each_chunk(chunks: DataFrame, work: Callable[[_Chunk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch):
                yield from work(chunk)

    return chunks.mapInArrow(run, schema)


def _sliced(columns: dict[str, pa.Array | np.ndarray]) -> Iterator[pa.RecordBatch]:
    table = pa.table(columns)
    yield from table.to_batches(max_chunksize=_ROWS)


def word_counts(chunks: DataFrame) -> DataFrame:
    """``word, n`` of every word of the training texts, stored."""

    def work(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        n = np.bincount(chunk.in_training(), minlength=len(chunk.words))
        seen = np.flatnonzero(n)
        words = pa.array(chunk.words, pa.binary()).take(pa.array(seen))
        yield from _sliced({"word": words, "n": n[seen].astype(np.int64)})

    counted = _each_chunk(chunks, work, "word binary, n bigint")
    return store(counted.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


# --- classes -------------------------------------------------------------------------


def pair_counts(chunks: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """Counts of consecutive pairs in the training texts, all other words taken as one more."""
    size = len(frequent) + 1
    number = {w: i for i, w in enumerate(frequent)}

    def work(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        place = np.array([number.get(w, size - 1) for w in chunk.words], np.int64)
        tokens = place[chunk.in_training()]
        if len(tokens):
            before = np.concatenate([tokens[-1:], tokens[:-1]])
            pair, n = np.unique(before * size + tokens, return_counts=True)
            yield from _sliced({"pair": pair, "n": n.astype(np.int64)})

    summed = _each_chunk(chunks, work, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    found = summed.toArrow()  # at most (FREQUENT + 1) ** 2 rows
    pairs = np.zeros(size * size)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    return pairs.reshape(size, size)


def _gains(flow: np.ndarray, mass: np.ndarray, left: np.ndarray, right: np.ndarray, n: float) -> np.ndarray:
    """What the likelihood gains if a word with these neighbour classes joins each class."""
    both = _flows(flow + left[:, None]) - _flows(flow)
    after = _flows(flow.T + right[:, None]) - _flows(flow.T)
    return both.sum(axis=0) + after.sum(axis=0) - 2 * (_flows(mass + n) - _flows(mass))


def exchange(pairs: np.ndarray, classes: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the frequent words, and the class bigram counts with all others as a last class.

    ``pairs`` counts consecutive words, most frequent first, the last one standing for all
    others. The first words found a class each; every further one joins the class that gains
    most, and then each word in turn is taken out and put where the gain is greatest, until
    a pass moves none.
    """
    words = len(pairs) - 1
    class_of = np.full(words + 1, classes)
    flow = np.zeros((classes + 1, classes + 1))
    flow[classes, classes] = pairs.sum()

    def move(w: int, to: int | None) -> int:
        own = class_of[w]
        left = np.bincount(class_of, pairs[:, w], classes + 1)
        right = np.bincount(class_of, pairs[w], classes + 1)
        twice = pairs[w, w]
        left[own] -= twice
        right[own] -= twice
        flow[:, own] -= left
        flow[own] -= right
        flow[own, own] -= twice
        if to is None:
            gains = _gains(flow, flow.sum(axis=0), left, right, pairs[:, w].sum())
            to = int(np.argmax(gains[:classes]))
        class_of[w] = to
        flow[:, to] += left
        flow[to] += right
        flow[to, to] += twice
        return to

    for w in range(words):
        move(w, w if w < classes else None)
    for _ in range(passes):
        before = class_of.copy()
        for w in range(words):
            move(w, None)
        if (class_of == before).all():
            break
    return class_of[:words], np.maximum(flow, 0)


def word_classes(chunks: DataFrame, frequent: dict[bytes, int], flow: np.ndarray) -> DataFrame:
    """``word, n, class`` of all words of the training texts, stored.

    Each chunk counts the classes before and after every word; the counts of a word meet in
    one place in order, and the word joins the class in which the likelihood of all training
    texts gains most. Frequent words keep the class they were exchanged into.
    """
    classes = len(flow) - 1
    mass = flow.sum(axis=0)
    # Before a word of class k comes h, and after it: gains are sums over neighbour classes.
    sides = [flow, flow.T]

    def contexts(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        tokens = chunk.in_training().astype(np.int64)
        if not len(tokens):
            return
        known = np.array([frequent.get(w, classes) for w in chunk.words], np.int64)
        of = known[tokens]
        before, after = np.concatenate([of[-1:], of[:-1]]), np.concatenate([of[1:], of[:1]])
        span = 2 * (classes + 1)
        key = np.concatenate([tokens * span + before, tokens * span + classes + 1 + after])
        key, n = np.unique(key, return_counts=True)
        entries = np.empty(len(key), _ENTRY)
        entries["context"], entries["n"] = key % span, n
        word = key // span
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        for k in range(0, len(starts), _ROWS):
            part = starts[k : k + _ROWS]
            ends = np.append(part[1:], starts[k + _ROWS] if k + _ROWS < len(starts) else len(key))
            packed = pa.Array.from_buffers(
                pa.binary(), len(part),
                [None, pa.py_buffer((np.append(part, ends[-1]) - part[0]).astype("<i4") * _ENTRY.itemsize), pa.py_buffer(entries[part[0] : ends[-1]].tobytes())],
            )
            yield pa.RecordBatch.from_arrays([pa.array([chunk.words[w] for w in word[part]], pa.binary()), packed], ["word", "contexts"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by word. The last word of a batch waits, summed up, for the next batch."""
        waiting: tuple[bytes, np.ndarray] | None = None

        def decide(words: list[bytes], sums: np.ndarray) -> pa.RecordBatch:
            n = sums[:, : classes + 1].sum(axis=1)
            chosen = np.empty(len(words), np.int32)
            for a in range(0, len(words), 1024):
                gains = -2 * (_flows(mass + n[a : a + 1024, None]) - _flows(mass))
                rows, columns = np.nonzero(sums[a : a + 1024])
                at = sums[a + rows, columns][:, None]
                base = np.concatenate(sides)[columns]
                np.add.at(gains, rows, _flows(base + at) - _flows(base))
                chosen[a : a + 1024] = np.argmax(gains[:, :classes], axis=1)
            chosen = [frequent.get(w, int(k)) for w, k in zip(words, chosen)]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(n.astype(np.int64)), pa.array(chosen, pa.int32())], ["word", "n", "class"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            words, packed = batch.column(0), batch.column(1)
            offsets = np.frombuffer(packed.buffers()[1], "<i4")[packed.offset : packed.offset + len(packed) + 1]
            entries = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(_ENTRY)
            new = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)])
            group = np.cumsum(new) - 1
            distinct = words.filter(pa.array(new)).to_pylist()
            sums = np.zeros((len(distinct), 2 * (classes + 1)))
            np.add.at(sums, (np.repeat(group, np.diff(offsets) // _ENTRY.itemsize), entries["context"]), entries["n"])
            if waiting and waiting[0] == distinct[0]:
                sums[0] += waiting[1]
            elif waiting:
                distinct.insert(0, waiting[0])
                sums = np.concatenate([waiting[1][None], sums])
            waiting = distinct.pop(), sums[-1].copy()
            if distinct:
                yield decide(distinct, sums[:-1])
        if waiting:
            yield decide([waiting[0]], waiting[1][None])

    counted = _each_chunk(chunks, contexts, "word binary, contexts binary")
    ordered = counted.repartition("word").sortWithinPartitions("word")
    return store(ordered.mapInArrow(choose, "word binary, n bigint, class int"), "word-classes")


# --- scores --------------------------------------------------------------------------


@dataclass(frozen=True)
class Emissions:
    """Bounded numbers of the model: per class, its tokens and its mass of unseen words."""

    tokens: int
    words: int
    discount: float
    log_mass: np.ndarray
    unseen: np.ndarray


def emissions(classed: DataFrame, classes: int = CLASSES) -> Emissions:
    """Absolute discounting inside each class: what is taken off goes to unseen words."""
    rows = classed.groupBy("class").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") == 2).alias("twice"),
    ).toArrow().to_pandas()
    once, twice = int(rows["once"].sum()), int(rows["twice"].sum())
    discount = once / (once + 2 * twice) if once and twice else 0.5
    mass, kinds = np.zeros(classes), np.zeros(classes)
    mass[rows["class"]], kinds[rows["class"]] = rows["n"], rows["words"]
    with np.errstate(divide="ignore", invalid="ignore"):
        unseen = np.where(mass > 0, discount * kinds / mass, 1.0)
        log_mass = np.where(mass > 0, np.log10(mass), 0.0)
    return Emissions(int(mass.sum()), int(kinds.sum()), discount, log_mass, unseen)


def _coded(chunks: DataFrame, classed: DataFrame, model: Emissions) -> DataFrame:
    """Per text ``id, trained, n_tokens, n_known, base_score, emitted`` and ``classes``, a byte each.

    The numbers of a chunk's words are joined with the classes of words, and come back to
    their chunk in one group, no larger than the chunk. 255 marks a word not in training.
    """

    def work(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        yield from _sliced({
            "chunk": np.full(len(chunk.words), chunk.number), "place": np.arange(len(chunk.words), dtype=np.int32),
            "word": pa.array(chunk.words, pa.binary()),
        })

    def code(_key: tuple, found: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for batch in rows.combine_chunks().to_batches():
            for chunk in _chunks(batch):
                n = np.zeros(len(chunk.words))
                of = np.full(len(chunk.words), 255, np.uint8)
                place = found["place"].to_numpy()
                n[place], of[place] = found["n"].to_numpy(), found["class"].to_numpy()
                base = np.log10((n + ALPHA) / (model.tokens + ALPHA * (model.words + 1)))
                known = of != 255
                emitted = np.zeros(len(n))
                emitted[known] = np.log10(n[known] - model.discount) - model.log_mass[of[known]]
                ends = np.cumsum(chunk.lengths)
                starts = ends - chunk.lengths

                def total(values: np.ndarray) -> np.ndarray:
                    return np.add.reduceat(values[chunk.tokens], starts)

                classes = of[chunk.tokens]
                out.append(pa.table({
                    "id": chunk.ids, "trained": chunk.trained, "n_tokens": chunk.lengths,
                    "n_known": total(known.astype(np.int64)), "base_score": total(base), "emitted": total(emitted),
                    "classes": pa.array([classes[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                }))
        return pa.concat_tables(out)

    numbered = _each_chunk(chunks, work, "chunk bigint, place int, word binary")
    found = numbered.join(classed, "word").select("chunk", "place", "n", "class")
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    schema = f"id {kind}, trained boolean, n_tokens bigint, n_known bigint, base_score double, emitted double, classes binary"
    grouped = found.groupBy("chunk").cogroup(chunks.groupBy("chunk"))
    return store(grouped.applyInArrow(code, schema), "coded-texts")


def transitions(coded: DataFrame, classes: int = CLASSES) -> np.ndarray:
    """log10 of the smoothed probability of each class after each, from the training texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for text in batch.column(0):
                of = np.frombuffer(text.as_buffer(), np.uint8).astype(np.int64)
                before = np.concatenate([of[-1:], of[:-1]])  # the end of a text comes before its start
                flow += np.bincount(before * classes + of, minlength=classes * classes)
        seen = np.flatnonzero(flow)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(flow[seen])], ["pair", "n"])

    counted = coded.filter("trained").select("classes").mapInArrow(work, "pair bigint, n bigint")
    found = counted.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most classes ** 2 rows
    flow = np.full(classes * classes, ALPHA)
    flow[found["pair"].to_numpy()] += found["n"].to_numpy()
    flow = flow.reshape(classes, classes)
    return np.log10(flow / flow.sum(axis=1, keepdims=True))


def _filled(of: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes with unseen words put into the likeliest class after the one before, and their places."""
    unseen = np.flatnonzero(of == 255)
    if len(unseen):
        of = of.copy()
        for place in unseen.tolist():
            of[place] = follow[of[place - 1]]
    return of, unseen


def scored(coded: DataFrame, model: Emissions, step: np.ndarray) -> DataFrame:
    """``coded`` with ``score``: log10 of class transitions and word emissions, summed over a text.

    An unseen word has the chance of any class after the one before times that class's mass
    of unseen words; the class that adds most to it is the context of the next word.
    """
    with np.errstate(divide="ignore"):
        joint = 10**step * model.unseen
        surprise, follow = np.log10(joint.sum(axis=1)), joint.argmax(axis=1).astype(np.uint8)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            emitted = batch.column("emitted").to_pylist()
            for text, said in zip(batch.column("classes"), emitted):
                of = np.frombuffer(text.as_buffer(), np.uint8)
                # The end of a text, unseen only without any training text, comes before its start.
                end = of[-1:] if of[-1] != 255 else np.zeros(1, np.uint8)
                padded, unseen = _filled(np.concatenate([end, of]), follow)
                steps = step[padded[:-1], padded[1:]]
                steps[unseen - 1] = surprise[padded[unseen - 1]]
                scores.append(said + float(steps.sum()))
            columns = [batch.column(c) for c in names] + [pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score"])

    names = ["id", "trained", "n_tokens", "n_known", "base_score"]
    kind = coded.schema["id"].dataType.simpleString()
    schema = f"id {kind}, trained boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    return coded.mapInArrow(work, schema)


def score_texts(
    df: DataFrame,
    training: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    classes: int = CLASSES,
    frequent: int = FREQUENT,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """``id_column, trained, n_tokens, n_known, train_tokens, base_score, score`` of every text.

    Tokens are the words of a text between ASCII white space, A-Z in lower case, then one
    end. Texts for which ``training`` holds teach the model: word counts, class counts and
    class bigrams cover all of them. ``base_score`` is the additively smoothed unigram score,
    ``score`` that of the class bigram model, both log10 of the text's probability;
    ``n_known`` counts tokens seen in training, ``train_tokens`` those of all training texts.

    The ``frequent`` most frequent words are exchanged between ``classes`` classes one by one;
    all others then join the class where the likelihood of the training texts gains most.

    Missing and empty texts are a single end. Ids may be missing or repeat; every row comes
    out once. A missing flag means not in training. Without any training text no token is
    known and both scores are those of the unseen word alone. An empty table gives no rows.
    """
    if not 1 <= classes <= min(254, frequent):
        raise ValueError("classes must be 1 to 254, and no more than the frequent words")
    chunks = encode(df, id_column, text_column, training, chunk_tokens)
    counts = word_counts(chunks)
    top = counts.orderBy(F.col("n").desc(), "word").limit(frequent).toArrow()["word"].to_pylist()
    class_of, flow = exchange(pair_counts(chunks, top), classes)
    classed = word_classes(chunks, dict(zip(top, class_of.tolist())), flow)
    model = emissions(classed, classes)
    coded = _coded(chunks, classed, model)
    found = scored(coded, model, transitions(coded, classes))
    return found.select(
        F.col("id").alias(id_column), "trained", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score",
    )
