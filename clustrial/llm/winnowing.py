"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrial.sources.tables import input_bytes, store

SPAN = 10  # words of a window, and the shortest span that is always found
GRAM = 5  # words of a hashed gram
GRAMS = SPAN - GRAM + 1  # grams among which the least is kept
BROADCAST_BYTES = 32 << 20
# A-Z are in the class of the raw text, as lowering them moves no word's ends.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def _gram(hashes: str, first: Column | int, length: int) -> Column:
    """Hash of ``length`` word hashes from a place on; places outside count for nothing."""
    at = F.lit(first) if isinstance(first, int) else first
    return F.xxhash64(F.lit(length), *[F.get(F.col(hashes), at + k) for k in range(length)])


def _with_words(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, print, words, hashes, n``: hashes ignore case more widely than words compare."""
    return (
        df.select(
            F.col(id_column).alias("id"),
            F.xxhash64(F.col(text_column), F.length(F.col(text_column))).alias("print"),
            _words(text_column).alias("words"),
        )
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
        .withColumn("n", F.size("words"))
    )


def _kept_place(df: DataFrame, start: str) -> DataFrame:
    """The least gram of the window at ``start``: ``key`` and ``place``, the last of equals."""
    grams = [f"_g{k}" for k in range(GRAMS)]
    df = df.withColumns({g: _gram("hashes", F.col(start) + k, GRAM) for k, g in enumerate(grams)})
    df = df.withColumn("key", F.least(*grams))
    place = F.coalesce(*[F.when(F.col(grams[k]) == F.col("key"), F.lit(k)) for k in reversed(range(GRAMS))])
    return df.withColumn("place", F.col(start) + place)


def benchmark_windows(
    items: DataFrame, id_column: str = "item_id", text_column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The distinct windows ``window, key, skip, length, passage``, and ``window, item`` pairs.

    A window is ``SPAN`` words in a row, or the whole of a shorter item. Its key is the hash
    of its least gram, ``skip`` words from its start; a short window is its own gram.
    """
    words = _with_words(items, id_column, text_column).filter("n > 0")
    starts = words.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - SPAN))))
    length = F.least(F.lit(SPAN), F.col("n"))
    short = F.coalesce(
        *[F.when(F.col("n") == k, _gram("hashes", 0, k)) for k in range(1, SPAN)], F.col("key")
    )
    found = _kept_place(starts, "start").select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"),
        short.alias("key"),
        F.when(F.col("n") >= SPAN, F.col("place") - F.col("start")).otherwise(0).alias("skip"),
        length.alias("length"),
        lower_ascii(F.array_join(F.slice("words", F.col("start") + 1, length), " ")).alias("passage"),
    )
    found = store(found.withColumn("window", F.sha2("passage", 256)).distinct(), "benchmark-windows")
    windows = store(
        found.groupBy("window", "key", "skip", "length", "passage").agg(F.count(F.lit(1)).alias("n_items")),
        "distinct-windows",
    ).drop("n_items")
    return windows, found.select("window", "item")


def _key_bits(windows: DataFrame, broadcast_bytes: int) -> Column | None:
    """All keys of the windows as a bit table, or None where their size has no small bound.

    The windows' stored bytes, at ten times their size on disk, must stay under
    ``broadcast_bytes``. The table has at least 128 bits for each key.
    """
    if 10 * input_bytes(windows) > broadcast_bytes:
        return None
    keys = [r["key"] for r in windows.select("key").distinct().collect()]
    size = 1 << max(12, (128 * len(keys)).bit_length())
    table = np.zeros(size, np.uint8)
    table[np.array(keys, np.int64) & (size - 1)] = 1
    longs = np.packbits(table, bitorder="little").view("<i8")
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")


def _may_match(key: Column, bits: Column | None) -> Column:
    """False only where no window has the key."""
    if bits is None:
        return F.lit(True)
    in_table = key.bitwiseAND(F.array_size(bits).cast("long") * 64 - 1)
    long = F.get(bits, F.shiftright(in_table, 6).cast("int"))
    return F.getbit(long, in_table.bitwiseAND(F.lit(63)).cast("int")) == 1


def _short_entries(places: Column, length: int, bits: Column | None, entry: Callable) -> Column:
    def gram(p: Column) -> Column:
        return _gram("hashes", p, length)

    near = F.filter(places, lambda p: _may_match(gram(p), bits))
    return F.transform(near, lambda p: entry(gram(p), p, length))


def _fingerprints(docs: DataFrame, short: list[int], bits: Column | None) -> DataFrame:
    """``id, print, n`` with each kept gram that may match: ``key, place, length, context``.

    Of every ``GRAMS`` grams in a row the least is kept, the last of equals; of the short
    windows' lengths all grams are. ``context`` are the words round a gram, from ``first``
    on, that its window can reach. Every row also gives one entry without key.
    """
    n_grams = F.greatest(F.lit(0), F.col("n") - (GRAM - 1))

    def counted(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def least(p: Column) -> Column:
        """Whether some ``GRAMS`` grams in a row have the gram at ``p`` as their last least."""
        starts = F.sequence(F.greatest(p - (GRAMS - 1), F.lit(0)), F.least(p, n_grams - GRAMS))

        def is_least(s: Column) -> Column:
            around, own = F.slice("grams", s + 1, GRAMS), F.get("grams", p)
            last = F.lit(GRAMS) - F.array_position(F.reverse(around), own)
            return (F.array_min(around) == own) & (last == p - s)

        return F.exists(starts, is_least)

    def entry(key: Column, place: Column, length: int) -> Column:
        reach = SPAN - GRAM if length == SPAN else 0
        first = F.greatest(F.lit(0), place - reach)
        return F.struct(
            key.alias("key"), place.alias("place"), F.lit(length).alias("length"), first.alias("first"),
            F.slice("words", first + 1, F.lit(SPAN + reach)).alias("context"),
        )

    docs = docs.withColumn("grams", F.transform(counted(n_grams), lambda i: _gram("hashes", i, GRAM)))
    near = F.filter(
        counted(n_grams), lambda p: (F.col("n") >= SPAN) & _may_match(F.get("grams", p), bits) & least(p)
    )
    entries = [F.transform(near, lambda p: entry(F.get("grams", p), p, SPAN))]
    for k in short:
        entries.append(_short_entries(counted(F.col("n") - (k - 1)), k, bits, entry))
    none = F.array(F.expr("named_struct('key', cast(null as bigint), 'place', 0, 'length', 0, 'first', 0, 'context', array(''))"))
    listed = docs.select("id", "print", "n", F.concat(none, *entries).alias("entries"))
    # The outer form, though no list is empty: the plain one adds a filter on the size of the
    # lists that the optimiser pushes to the scan, where it computes them again, word by word.
    return listed.select("id", "print", "n", F.explode_outer("entries").alias("e")).select("id", "print", "n", "e.*")


def occurrences(
    df: DataFrame,
    windows: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``id, print, n, start, length, window`` of every window's occurrence in every text.

    Each row of ``df`` also gives one row without ``start``. ``print`` tells texts apart
    that share an id.

    Two texts with a window in common keep the same gram of it, the least, at the same place
    within it; so joining kept grams finds every occurrence, and the hit is extended to the
    window and compared word by word. Where all windows together are small, grams that no
    window has are dropped before the join by a table of their bits; otherwise all kept
    grams are joined, by shuffle, each with the words it can reach.
    """
    docs = _with_words(df, id_column, text_column)
    short = sorted(r["length"] for r in windows.filter(F.col("length") < SPAN).select("length").distinct().collect())
    kept = _fingerprints(docs, short, _key_bits(windows, broadcast_bytes)).alias("d")
    is_row = F.col("d.key").isNull()
    begin = F.col("d.place") - F.col("w.skip")
    same_key = (F.col("d.key") == F.col("w.key")) & (F.col("d.length") == F.col("w.length"))
    fits = (begin >= 0) & (begin + F.col("w.length") <= F.col("d.n"))
    span = F.slice("d.context", begin - F.col("d.first") + 1, F.col("w.length"))
    same = F.when(fits, lower_ascii(F.array_join(span, " ")) == F.col("w.passage"))
    joined = kept.join(windows.alias("w"), same_key, "left")
    return joined.filter(is_row | F.coalesce(same, F.lit(False))).select(
        "d.id", "d.print", "d.n",
        F.when(~is_row, begin).alias("start"),
        F.when(~is_row, F.col("w.length")).alias("length"),
        F.when(~is_row, F.col("w.window")).alias("window"),
    )


def contamination(
    df: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row.

    Missing texts have no words. Repeated rows come out as often as they go in; rows that
    share an id but not the text are judged one by one. A missing item id is written as the
    empty string, items that share an id count as one, and without items nothing is hit.
    """
    windows, members = benchmark_windows(items, item_column, item_text)
    found = occurrences(df, windows, id_column, text_column, broadcast_bytes)
    found = found.groupBy("id", "print", "n", "start", "length", "window").agg(F.count(F.lit(1)).alias("rows"))
    found = store(found, "occurrences")
    text = ["id", "print", "n"]
    in_order = Window.partitionBy(*text).orderBy(F.col("start").asc_nulls_first(), "length")
    end = F.col("start") + F.col("length")
    reached = F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(reached, F.col("start"))))
    covered = found.withColumn("new", new).groupBy(*text).agg(
        F.coalesce(F.sum("new"), F.lit(0)).alias("n_hit"),
        F.sum(F.when(F.col("start").isNull(), F.col("rows"))).alias("rows"),
    )
    named = (
        found.filter("start is not null").select("id", "print", "window").distinct()
        .join(members, "window").groupBy("id", "print")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    joined = covered.alias("c").join(
        named.alias("t"), F.col("c.id").eqNullSafe(F.col("t.id")) & (F.col("c.print") == F.col("t.print")), "left"
    )
    items_list = F.coalesce(F.col("t.items"), F.array().cast("array<string>"))
    return joined.select(
        F.col("c.id").alias("doc_id"),
        F.col("c.n").cast("long").alias("n_words"),
        F.col("c.n_hit").cast("long").alias("n_hit"),
        F.size(items_list).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_list, ","), 256).alias("items_sha256"),
        (F.col("c.n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("c.rows"))).alias("_row"),
    ).drop("_row")


def drop_contaminated(
    df: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows of ``df``, all columns, without those that hold a window of an item."""
    windows, _ = benchmark_windows(items)
    found = occurrences(df, windows, id_column, text_column, broadcast_bytes)
    hit = store(found.filter("start is not null").select("id", "print").distinct(), "contaminated")
    own_id, own_text = F.col(f"_docs.{id_column}"), F.col(f"_docs.{text_column}")
    same_text = F.xxhash64(own_text, F.length(own_text)) == F.col("_hits.print")
    return df.alias("_docs").join(hit.alias("_hits"), own_id.eqNullSafe(F.col("_hits.id")) & same_text, "left_anti")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS passage
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, l, p, array_to_string(w[p : p + l - 1], ' ') AS passage
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d CROSS JOIN ls WHERE len(w) >= l)),
hits AS (SELECT doc_id, item_id, l, p FROM dw JOIN bw USING (l, passage)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
