"""Token chunks, shards and packing: exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clustrial.llm import tokens
from clustrial.llm.elias_fano import EliasFano
from clustrial.llm.packing import best_fit_decreasing, cut_pieces, lower_bound, pack, pack_documents
from clustrial.llm.token_files import read_token_files, write_token_files
from clustrial.llm.tokens import END_ID, TextEncoder, default_tokenizer
from clustrial.sources.tables import shared_folder
from tests.llm.helpers import AWKWARD, documents

SAMPLES = ["", " ", "   ", "a  b", "a   b", "a \n b", "a\n\nb ", "it's they'll", "x y   z", "12 3a4 .5", "É é\n ", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def work():
    return TextEncoder(default_tokenizer(), max_chunks=50)


def ids(work, text):
    return work.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunked_ids_equal_the_library(work):
    random.seed(1)
    letters = ["a", "é", " ", "  ", "\n", "\t", "1", ".", "'s", "-", "<", "日", " ", "Z", "\x1c"]
    made = ["".join(random.choices(letters, k=random.randint(1, 14))) for _ in range(5000)]
    for text in [*SAMPLES, *made, "Then, again. " * 200]:
        assert work.encode(text).tolist() == ids(work, text), repr(text)


def test_added_tokens_are_those_of_a_plain_library_call(work):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(default_tokenizer()))
    assert work.encode("a <|endoftext|> x").tolist() == [64, 220, 50256, 2124]
    random.seed(3)
    parts = ["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "   ", "\n", "a", "It's", ".", "1", "\t"]
    for text in [*SAMPLES, *("".join(random.choices(parts, k=random.randint(1, 9))) for _ in range(3000))]:
        assert work.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_texts_encoded_together_equal_the_library(work):
    random.seed(5)
    letters = ["It's", "é", " ", "  ", "\n", "\t", "12", ".", "'ll", "\0", "日", "\x85", "²", "[x]", "<|endoftext|>", "Ġ", "\u3000"]
    made = ["".join(random.choices(letters, k=random.randint(0, 9))) for _ in range(4000)]
    texts = [None, *SAMPLES, *made, "", None]
    got = work.encode_all(pa.array(texts).slice(1))
    assert [x.tolist() for x in got] == [ids(work, t) for t in texts[1:]]
    assert work.encode_all(pa.array([], pa.string())) == []


def test_every_kind_of_white_space_is_known_to_the_cuts(work):
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    texts = [f"a{x} {y}b" for x in spaces for y in ["", *spaces]] + [f"a{x} " for x in spaces]
    assert [x.tolist() for x in work.encode_all(pa.array(texts))] == [ids(work, t) for t in texts]


def test_plain_chunks_go_to_the_model_once_for_each_pre_token():
    work = TextEncoder(default_tokenizer())
    seen, tokenize, chained, whole = [], work.tokenize, [], work.whole
    work.tokenize = lambda text: seen.append(text) or tokenize(text)
    work.whole = lambda text: chained.append(text) or whole(text)
    texts = ["It's (a) test, a\ntest; no. 12: été", "a test (a) it's\na test, 12"] * 300
    got = work.encode_all(pa.array(texts))
    assert len(seen) == len(set(seen)) and max(map(len, seen)) <= 6
    assert sorted(chained) == ["", "\n"]
    assert [x.tolist() for x in got[:2]] == [ids(work, t) for t in texts[:2]]


def test_batches_are_cut_into_slices_at_any_row(monkeypatch, work):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 40)
    texts = ["x" * 90, None, "", "a b", *["one two three"] * 20, "y " * 70, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    got = list(tokens.encoded_rows(iter([batch, batch.slice(0, 0)]), default_tokenizer()))
    assert [(k, x.tolist()) for k, x in got] == [(k, [*ids(work, t), END_ID]) for k, t in enumerate(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40)))
def test_elias_fano_keeps_all_values(values):
    values = sorted(values)
    code = EliasFano.frombytes(EliasFano.encode(np.array(values, np.uint64)).tobytes())
    assert code.values().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values
    for first in range(0, len(values) + 1, 7):
        assert code.run(first, len(values)).tolist() == values[first:]
        assert code.run(0, first).tolist() == values[:first]


def test_runs_of_many_values_start_at_any_place():
    rng = np.random.default_rng(4)
    values = np.cumsum(rng.integers(0, 9000, 3000) * (rng.random(3000) < 0.4))
    code = EliasFano.frombytes(EliasFano.encode(values).tobytes())
    for first, last in [(0, 3000), (255, 257), (256, 512), (1, 2), (2999, 3000), (700, 700), (511, 2049)]:
        assert code.run(first, last).tolist() == values[first:last].tolist()


def test_equal_rows_and_rows_of_unknown_size_are_spread_over_shards(spark):
    rows = [(0, "the same placeholder")] * 20_000 + [(i, f"text {i}") for i in range(1, 2000)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    folder, manifest = write_token_files(df, shard_bytes=2000)
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) > 5 and sum(sizes) == len(rows) and max(sizes) < 6_000
    got = read_token_files(spark, folder, manifest)
    placeholder = got.filter("doc_id = 0").groupBy("n_tokens", "ids_crc32").count().collect()
    assert len(placeholder) == 1 and placeholder[0]["count"] == 20_000
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in got.collect())
    assert [s for s, _, _ in starts] == list(np.cumsum([0, *[n for _, n, _ in starts]])[:-1])
    assert [d for _, _, d in starts] == sorted(d for d, _ in rows)


def test_elias_fano_is_near_minimal():
    values = np.arange(100_000) * 700
    assert len(EliasFano.encode(values).tobytes()) * 8 / len(values) < 2 + np.log2(700) + 0.6


def test_shards_give_every_document_back(spark, work):
    path = f"{shared_folder(spark)}/awkward"
    documents(spark, AWKWARD).write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    folder, manifest = write_token_files(df, shard_bytes=4000)
    got = read_token_files(spark, folder, manifest, with_ids=True).orderBy("start").collect()
    want = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0]))
    assert manifest.count() > 1
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted(map(tuple, (r.ids for r in got))) == sorted(tuple([*ids(work, t), END_ID]) for _, t in want)
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_an_empty_table_gives_no_shard(spark):
    folder, manifest = write_token_files(documents(spark, [(1, "x")]).limit(0))
    assert read_token_files(spark, folder, manifest).count() == 0


def test_pieces_and_sequences(spark, work):
    df = documents(spark, AWKWARD)
    rows = pack_documents(df, size=64).collect()
    total = sum(len(ids(work, t)) + 1 for _, t in AWKWARD)
    assert sum(r.length for r in rows) == total
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for placed in bins.values():
        placed.sort(key=lambda r: r.offset)
        assert [r.offset for r in placed] == list(np.cumsum([0, *[r.length for r in placed]])[:-1])
        assert sum(r.length for r in placed) <= 64
    assert len(bins) <= -(-total // 64) + 1
    long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece)
    assert [r.start for r in long] == list(np.cumsum([0, *[r.length for r in long]])[:-1])
    assert all(r.length == 64 for r in long[1:])
    assert sum(r.doc_id == 7 for r in rows) == 2 and sum(r.doc_id == 1 for r in rows) == 1
    with_ids = cut_pieces(df.where("doc_id = 5"), 64, with_ids=True).orderBy("piece").collect()
    assert [x for r in with_ids for x in r.ids] == [*ids(work, AWKWARD[4][1]), END_ID]
    assert pack_documents(df.limit(0)).count() == 0


def test_exchange_rounds_merge_what_groups_leave(spark):
    random.seed(2)
    lengths = [random.randint(1, 99) for _ in range(3000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lengths)], "k long, length long")
    rows = pack(df, size=100, group_pieces=200).collect()
    assert sorted((r.k, r.length) for r in rows) == sorted(enumerate(lengths))
    alone = best_fit_decreasing(np.array(lengths), 100)[2]
    assert len({r.sequence_id for r in rows}) <= len(alone) * 1.03


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_the_bound_never_exceeds_the_optimum(lengths):
    def fits(k, rooms):
        if k == len(lengths):
            return True
        return any(
            room >= lengths[k] and fits(k + 1, rooms[:b] + (room - lengths[k],) + rooms[b + 1 :]) for b, room in enumerate(rooms)
        )

    best = next(n for n in range(1, 9) if fits(0, (20,) * n))
    bound = lower_bound(np.bincount(lengths, minlength=21))
    assert bound <= best <= len(best_fit_decreasing(np.array(lengths), 20)[2])
