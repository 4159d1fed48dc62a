"""Rule bitmask ledger: every quality rule evaluated once, policies applied to the bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
REPEAT_WINDOW = 8

#: name, and the SQL condition over the measurements under which a text fails; the order
#: fixes the bits and is only ever added to.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("duplicate_lines", "n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    ("shouting", "100 * n_upper > 30 * n_words"),
    ("no_sentence_end", "n_words >= 100 and 300 * n_ends < n_words"),
    ("few_letters", "100 * n_letters < 60 * word_chars"),
]
BASE_RULES = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of what is not tolerated: a text stays if it fails none of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << bit for bit, (name, _) in enumerate(RULES) if name in rules)


POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_words")),
    "v2": Policy("v2", ("few_words", "repeated_words", "symbols", "duplicate_lines", "shouting")),
    "v3": Policy("v3", tuple(name for name, _ in RULES)),
}
CURRENT = "v3"


def _length_without(pattern: str) -> Column:
    return F.length(F.regexp_replace("_text", pattern, ""))


def measurements(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and the counts that the rules read, of every row, without a shuffle.

    Words are runs of anything but ASCII white space. A repeated word lies in a window of
    eight words that comes twice or more in the text, first time included; windows are
    compared by a 64-bit hash. A duplicate line has a word and equals an earlier line. A
    missing text is empty, and all counts of an empty text are 0.
    """
    df = df.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    windows = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_words") - (REPEAT_WINDOW - 1)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    df = df.withColumns(
        {
            "_grams": F.transform(windows, lambda i: F.xxhash64(F.slice("_words", i, REPEAT_WINDOW))),
            "_lines": lines,
        }
    )
    df = df.withColumn("_again", F.size("_grams") > F.size(F.array_distinct("_grams")))
    # Copies of a window stand next to each other once windows are sorted by hash.
    pairs = F.when(F.col("_again"), F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    df = df.withColumn("_sorted", pairs)
    same = F.zip_with(
        F.slice("_sorted", F.lit(1), F.size("_sorted") - 1),
        F.slice("_sorted", F.lit(2), F.size("_sorted") - 1),
        lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    df = df.withColumn("_places", F.when(F.col("_again"), places))
    gaps = F.zip_with(
        F.slice("_places", F.lit(1), F.size("_places") - 1),
        F.slice("_places", F.lit(2), F.size("_places") - 1),
        lambda a, b: F.least(F.lit(REPEAT_WINDOW), b - a),
    )
    repeated = F.when(F.col("_again"), F.aggregate(gaps, F.lit(REPEAT_WINDOW), lambda s, x: s + x)).otherwise(0)
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": _length_without(r"[^#*$%&|<>]+"),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated,
        "n_upper": F.regexp_count("_text", F.lit(r"(?<![^\x20\x09-\x0D])\p{Lu}{2}[^\x20\x09-\x0D\p{Ll}]*+(?![^\x20\x09-\x0D])")),
        "n_ends": _length_without(r"[^.!?]+"),
        "n_letters": _length_without(r"\P{L}+"),
    }
    return df.select("doc_id", *[c.cast("long").alias(name) for name, c in counts.items()])


def ledger(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measurements of every row and ``failed``, a bit for each rule it fails.

    Store this once; policies and ablations read it without touching texts again.
    """
    bits = [f"if({failing}, {1 << bit}L, 0L)" for bit, (_, failing) in enumerate(RULES)]
    return measurements(df, id_column, text_column).withColumn("failed", F.expr(" | ".join(bits)))


def apply_policy(entries: DataFrame, policy: Policy = POLICIES[CURRENT]) -> DataFrame:
    """A ledger with ``kept``, false where a rule of the policy fails, and the policy's version."""
    kept = F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0
    return entries.withColumns({"kept": kept, "policy": F.lit(policy.version)})


def ablations(entries: DataFrame, policy: Policy = POLICIES[CURRENT]) -> DataFrame:
    """For each rule of a policy: texts failing it, and those that only it rejects.

    Entries are first counted by their bits, on the map side, so there is at most a row for
    each set of failed rules; ``failed_any`` and ``failed_all`` are the or and the and of
    all bits. An empty ledger gives counts of 0.
    """
    of_policy = F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")
    by_bits = entries.groupBy(of_policy).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).alias("bit"))
        for bit, (name, _) in enumerate(RULES) if name in policy.rules
    ])
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    none = by_bits.limit(0).union(by_bits.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(0).cast("long")))
    return (
        by_bits.union(none).withColumn("r", F.explode(rules)).groupBy("r.rule", "r.bit").agg(
            F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
            F.bit_or("bits").alias("failed_any"),
            F.bit_and("bits").alias("failed_all"),
        )
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
d AS (SELECT row_number() OVER () AS r, * FROM t),
g AS (
  SELECT r, p, array_to_string(w[p : p + 7], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, p FROM g JOIN (SELECT r, gram FROM g GROUP BY ALL HAVING count(*) > 1) USING (r, gram)),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))) AS n_lines,
    len(list_distinct(list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')))) AS n_own_lines,
    coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda s: regexp_matches(s, '^\p{Lu}{2}\P{Ll}*$'))) AS n_upper,
    length(regexp_replace(x, '[^.!?]+', '', 'g')) AS n_ends,
    length(regexp_replace(x, '\P{L}+', '', 'g')) AS n_letters
  FROM d LEFT JOIN rep USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_lines - n_own_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 20 * n_words
    OR (n_lines >= 5 AND 100 * (n_lines - n_own_lines) > 30 * n_lines) OR word_chars < 2 * n_words OR word_chars > 16 * n_words
    OR 100 * n_upper > 30 * n_words OR (n_words >= 100 AND 300 * n_ends < n_words)
    OR 100 * n_letters < 60 * word_chars) AS kept
FROM m
"""
