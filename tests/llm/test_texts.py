"""Windows, rules, fingerprints and pseudonyms against brute force."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from clustrial.llm import pii, quality_rules, simhash, winnowing
from clustrial.llm.components import components
from clustrial.sources.tables import store
from tests.llm.helpers import AWKWARD, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "the quick brown fox jumps over a lazy dog while the Éclair sat on 42 shelves"
ITEMS = [(1, PASSAGE), (2, "tiny item"), (3, None), (4, ""), (5, PASSAGE), (6, "é É é É é É é É é É é É"), (None, "no id " * 6)]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_contamination(docs, items):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for item, passage in items:
            b = words(passage)
            span = min(10, len(b))
            for p in range(len(b) - span + 1 if b else 0):
                for q in range(len(w) - span + 1):
                    if w[q : q + span] == b[p : p + span]:
                        hit |= set(range(q, q + span))
                        names.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(names), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [winnowing.BROADCAST_BYTES, 0])
def test_every_shared_window_is_found(spark, bound):
    cut = PASSAGE.split()
    docs = [
        *AWKWARD, (20, "x " + PASSAGE.upper().replace("É", "é")), (21, "x " + PASSAGE.lower() + " y " + PASSAGE), (22, " ".join(cut[1:11])),
        (23, " ".join(cut[1:10])), (24, "a TINY, item! and tiny items"), (25, "é É é É é É é É é É é É é É"), (26, "é " * 30), (27, "no id " * 40),
    ]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = winnowing.contamination(documents(spark, docs), items, broadcast_bytes=bound)
    assert sorted(
        ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()), key=str
    ) == brute_contamination(docs, ITEMS)
    kept = winnowing.drop_contaminated(documents(spark, docs), items, broadcast_bytes=bound)
    clean = [r[0] for r in brute_contamination(docs, ITEMS) if not r[4]]
    assert sorted(map(str, clean)) == sorted(str(r.doc_id) for r in kept.collect()) and "lang" in kept.columns


def test_no_items_hit_nothing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    rows = winnowing.contamination(documents(spark, AWKWARD), items).collect()
    assert len(rows) == len(AWKWARD) and not any(r.contaminated or r.n_items for r in rows)
    empty = documents(spark, AWKWARD).limit(0)
    assert winnowing.contamination(empty, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    many = Counter(grams)
    again = {q for k, g in enumerate(grams) if many[g] > 1 for q in range(k, k + 8)}
    return (
        len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again),
    )


def test_rules_ledger(spark):
    docs = [
        *AWKWARD, (30, "a b c d e f g h " * 2 + "x"), (31, "l1\nl1\n \nl2\nl1"), (32, "A## $b | c<d> & e"), (33, "SHOUT THIS!! " * 30),
        (34, " ".join(f"{a}word{b}." for a in "abcdefgh" for b in "klmnopqr")),
    ]
    entries = quality_rules.ledger(documents(spark, docs)).cache()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in entries.collect()]
    assert sorted(got, key=str) == sorted(((i, *brute_measures(t)) for i, t in docs), key=str)
    kept = quality_rules.apply_policy(entries).filter("kept").select("doc_id").collect()
    assert [r.doc_id for r in kept] == [34]
    report = {r.rule: r for r in quality_rules.ablations(entries).collect()}
    failed = [r.failed for r in entries.collect()]
    mask = quality_rules.POLICIES[quality_rules.CURRENT].mask
    for bit, (name, _) in enumerate(quality_rules.RULES):
        assert report[name].n_failed == sum(f >> bit & 1 for f in failed)
        assert report[name].n_only == sum(f & mask == 1 << bit for f in failed)
        assert report[name].n_kept == 1
    assert quality_rules.ablations(entries.limit(0)).filter("n_failed > 0").count() == 0


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    hashes = [xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    base = " ".join(f"token{k}" for k in range(400))
    docs = [*AWKWARD, *[(100 + k, base.replace(f"token{k * 7} ", f"other{k} ")) for k in range(30)]]
    rows = simhash.near_duplicates(documents(spark, docs)).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    assert sorted(((r.doc_id, r.fp % 2**64) for r in rows), key=str) == sorted(((i, f) for (i, _), f in zip(docs, fps)), key=str)
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((i for (i, _), h in zip(docs, group) if h == g and i is not None), default=None) for g in set(group)}
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted(
        ((i, least[g]) for (i, _), g in zip(docs, group)), key=str
    )
    kept = simhash.one_of_each(documents(spark, docs), simhash.near_duplicates(documents(spark, docs)))
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, [*{x for x in least.values() if x is not None}, None]))
    assert simhash.near_duplicates(documents(spark, docs).limit(0)).count() == 0


def test_one_row_of_each_group_whatever_its_ids(spark):
    words = {c: " ".join(f"{c}{k}" for k in range(400)) for c in "abcdef"}
    near = words["e"].replace("e20 ", "other ")
    assert (simhash.fingerprint(near) ^ simhash.fingerprint(words["e"])).bit_count() <= 3
    docs = [(0, words["a"]), (0, words["b"]), (0, words["c"]), (0, words["a"]), (5, words["d"]), (9, words["d"]), (9, words["f"])]
    docs += [(None, words["e"]), (None, near), (None, words["e"]), (None, words["a"]), (3, None), (None, "")]
    df = documents(spark, docs)
    rows = simhash.one_of_each(df, simhash.near_duplicates(df)).collect()
    got = [(r.doc_id, r.text) for r in rows]
    kept_e = [t for i, t in got if i is None]
    assert len(kept_e) == 1 and kept_e[0] in {near, words["e"]}
    assert sorted((i, t or "") for i, t in got if i is not None) == sorted(
        [*((0, words[c]) for c in "abc"), (3, ""), (5, words["d"]), (9, words["f"])]
    )
    assert rows[0].__fields__ == df.columns


def test_links_within_three_bits_are_all_found(spark):
    import random

    random.seed(4)
    seeds = [random.getrandbits(64) for _ in range(20)]
    fps = {s ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for s in seeds for _ in range(15)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {frozenset((r.a, r.b)) for r in links.collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3}
    assert got == want


def test_balls_of_fingerprints_are_not_broadcast(spark):
    fps = store(spark.range(500).select(F.xxhash64("id").alias("fp")))
    near = store(fps.union(fps.limit(5).select(F.col("fp").bitwiseXOR(F.lit(3)))))
    links = simhash.fingerprint_links(near)
    assert links.count() == 5
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_rows_of_copies_are_not_broadcast(spark):
    texts = [(k, " ".join(f"{k % 3}w{j}" for j in range(20))) for k in range(60)]
    found = simhash.near_duplicates(documents(spark, texts))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(k, k % 3) for k in range(60)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin(\(skew=true\))? \[fp#\d+L\], \[fp#", plan)
    assert not re.search(r"BroadcastHashJoin \[fp#\d+L\], \[fp#", plan)


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(200)] + [(500, 499), (7, 7), (600, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys((499, 500, 600), 499)}


PII = [
    (1, "mail Und.34@mail7.example.com, und.34@mail7.example.com end"), (2, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'),
    (3, "4785380592391139 and 4785-3805-9239-1139 and 1234567812345678"), (4, "152.143.123.131 not 1.2.3.400 nor v1.2.3.4.5"),
    (5, "2024-02-29 2024-02-30 31/12/1999 1999-13-01"), (6, "+1 (017) 555-7713 and 123-45-6789 and 000-45-6789"), (7, None), (8, ""), (9, "4.0"),
]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_the_format(spark):
    found = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(PII, "doc_id long, text string"), "k").collect()}
    mails = [x.new for x in found[1].pii_found]
    assert mails[0] == mails[1] and re.fullmatch(r"[a-z0-9]{3}\.[a-z0-9]{2}@mail7\.example\.com", mails[0]) and "und.34" not in found[1].text
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', found[2].text) and found[2].text != PII[1][1]
    first, second, third = found[3].text.split(" and ")
    assert luhn(first) and first == second.replace("-", "") and first != "4785380592391139" and third == "1234567812345678"
    ip, rest = found[4].text.split(" ", 1)
    assert rest == "not 1.2.3.400 nor v1.2.3.4.5" and all(0 <= int(x) < 256 for x in ip.split("."))
    assert re.fullmatch(r"\d{4}-\d\d-\d\d 2024-02-30 \d\d/\d\d/\d{4} 1999-13-01", found[5].text)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and (?!000|666|9)\d{3}-(?!00)\d\d-\d{4} and 000-45-6789", found[6].text)
    assert found[7].text is None and found[8].text == "" and found[9].text == "4.0" and found[9].pii_found == []
    again = pii.pseudonymise(spark.createDataFrame(PII, "doc_id long, text string"), "other").filter("doc_id = 3").first()
    assert again.text != found[3].text


def test_the_permutation_is_one_to_one(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"), F.col("id").alias("d"))
    moved = numbers.select(F.expr(pii.permuted("v", pii.DIGITS, "k", "t")).alias("v"), F.expr(pii._permuted_day("d * 146", "k")).alias("d"))
    assert sorted(r.v for r in moved.collect()) == [f"{k:03d}" for k in range(1000)]
    days = {r.d for r in moved.collect()}
    assert len(days) == 1000 and min(days) >= 0 and max(days) < 146097


def test_pseudonyms_leave_other_columns_and_awkward_rows(spark):
    df = documents(spark, AWKWARD)
    out = pii.pseudonymise(df, "k")
    assert out.columns == [*df.columns, "pii_found"]
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (None, "x y z q r s"), (3, None)]
    names = {"_text_hash": 1, "_doc_id": 2, "chosen_id": 3, "chosen_hash": 4, "_id": 5, "hash": 6}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in names.items()})
    kept = simhash.one_of_each(df, simhash.near_duplicates(df))
    assert kept.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(str((*r, *names.values())) for r in (rows[0], rows[2], rows[3]))
