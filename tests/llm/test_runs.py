"""Periodic runs against brute force."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from clustrial.llm import periodic_runs
from tests.llm.helpers import AWKWARD, documents


def brute_runs(w, min_length=24, min_periods=3):
    out, n = set(), len(w)
    for p in range(1, n // min_periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(min_length, min_periods * p):
                if not any(all(w[k] == w[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                    out.add((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    ends = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *ends, sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest())


def random_texts(rnd, count):
    for i in range(count):
        n, letters = rnd.randint(0, 150), rnd.choice([1, 2, 3, 30, 500])
        w = [f"w{rnd.randrange(letters)}" for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            if n > 40:
                a, p = rnd.randrange(n - 30), rnd.randint(1, 9)
                for k in range(a + p, min(n, a + rnd.randint(20, 80))):
                    w[k] = w[k - p]
        yield i, rnd.choice([" ", "\n", "  ", "\t \x0b"]).join(w)


def test_query_rows_same_as_brute_force(spark):
    rnd = random.Random(7)
    rows = [*random_texts(rnd, 300), *AWKWARD, (6, " x" * 400), (11, "a b c " * 30 + "a b d " * 30), (12, "\x0c q\x1fq q" * 40), (13, "x y " * 30)]
    found = periodic_runs.run_digests(documents(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((brute(*r) for r in rows), key=str)
    assert sum(brute(*r)[1] > 0 for r in rows) > 50


@pytest.mark.parametrize("limits", [(2, 2), (5, 2), (9, 2), (6, 3), (12, 4)])
def test_other_limits(limits):
    rnd = random.Random(sum(limits))
    for _ in range(150):
        texts = [[b"%d" % rnd.randrange(k) for _ in range(rnd.randint(0, 40))] for k in (1, 2, 2, 3, 8)]
        assert periodic_runs._block(texts, *limits) == [brute_runs(t, *limits) for t in texts]


def test_long_texts_take_no_quadratic_time():
    x, y = b"a", b"ab"
    while len(y) < 60_000:
        x, y = y, y + x
    for words in ([b"a"] * 200_000, [b"%d" % (i % 999) for i in range(200_000)], [y[i : i + 1] for i in range(len(y))]):
        assert periodic_runs._block([words], 24, 3)[0]


def test_positions_stay_in_order_in_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_PART", 4)
    rnd = random.Random(1)
    places = rnd.sample(range(1000), 300)
    kept, plain = periodic_runs._Positions(places[0]), [places[0]]
    for x in places[1:]:
        before = max((v for v in plain if v < x), default=-1)
        after = min((v for v in plain if v > x), default=-1)
        assert kept.add(x) == (before, after)
        plain.append(x)
    assert list(kept) == sorted(plain) and kept.size == 300 and max(map(len, kept.parts)) <= 8


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, start long")
    assert periodic_runs.run_digests(none).collect() == []
