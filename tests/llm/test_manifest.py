"""The manifest against a plain tree."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from clustrial.llm import manifest
from tests.llm.helpers import AWKWARD, documents

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def climb(tree, place, digest, siblings):
    for nodes in tree[:-1]:
        run = range(place // 3 * 3, min(place // 3 * 3 + 3, len(nodes)))
        siblings += [nodes[k] for k in run if k != place]
        digest = h("".join(digest if k == place else nodes[k] for k in run))
        place //= 3
    return digest


def brute(rows):
    def tampered(row):
        chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
        return (*row[:4], row[4].replace("\n", "")) if chosen else row

    key = lambda v: (v is not None, str(v).encode())
    sources = sorted({r[1] for r in rows}, key=key)
    groups = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in groups[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for place, row in enumerate(groups[s]):
            siblings = []
            folded = climb(top, k, climb(trees[s], place, leaf(tampered(row)), siblings), siblings)
            # The second climb starts from the tampered subroot; its siblings are the same.
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[s][-1][0], root, h("".join(siblings)), folded, folded == root))
    return sorted(out, key=str)


def cases():
    many = [(i, f"s{i % 3 if i % 4 else 9}", "en" if i % 5 else None, i, f"line {i}\n\nmore\n" if i % 2 else f"é☃ {i}") for i in range(160)]
    odd = [(None, None, None, None, None), (None, None, None, None, None), (5, None, "en", 0, ""), (5, None, "en", 0, ""), (-7, "ü", "x", 3, "a\nb"), (7, "", "x", 3, "\n"), (8, "solo", "de", 2, "x")]
    return {"many": many + odd, "copies": [(0, "s", "en", 1, "same\n")] * 70 + [(1, "s", "en", 1, "other")], "one": [(3, "s", "en", 1, "x\ny")], "none": []}


@pytest.mark.parametrize("name", cases())
@pytest.mark.parametrize("block", [1, 2, 7])
def test_same_as_a_plain_tree(spark, monkeypatch, name, block):
    rows = cases()[name]
    monkeypatch.setattr(manifest.proofs, "__defaults__", ("source", ("doc_id",), "leaf", block))
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = sorted((tuple(r) for r in manifest.tampered_proofs(df).collect()), key=str)
    assert got == brute(rows)


def test_awkward_rows_and_names(spark, many_slices):
    found = manifest.tampered_proofs(documents(spark, AWKWARD)).collect()
    assert len(found) == len(AWKWARD) and len({r.root for r in found}) == 1
    leaves = documents(spark, AWKWARD).select(
        F.sha2(F.coalesce("text", F.lit("-")), 256).alias("leaf"), "doc_id", "source", "key", F.lit(1).alias("below"),
        F.lit(2).alias("path"), F.lit(3).alias("root"), F.lit(4).alias("grp"), F.lit(5).alias("a.b"),
    )
    out = manifest.proofs(leaves, levels=2)
    assert out.columns == ["leaf", "doc_id", "source", "key", "below", "path", "grp", "a.b", "subroot", "root", "proof"]
    assert out.filter(manifest.folded("leaf") == F.col("root")).count() == len(AWKWARD)


def test_no_row_holds_more_than_a_block(spark):
    rows = spark.range(500).selectExpr("id as doc_id", "'hot' as source", "sha2(cast(id as string), 256) as leaf")
    ranked = manifest._ranked(
        rows.selectExpr("source as grp", "leaf as digest", "struct(doc_id) as below", "0L as tie"), ["doc_id"]
    )
    blocks = manifest._rolled_up(ranked, 2)
    sizes = blocks.selectExpr("aggregate(below, 0, (n, c) -> n + size(c.below)) as n").collect()
    assert len(sizes) == 56 and max(r.n for r in sizes) == 9
