"""Small tables with every awkward case."""

from __future__ import annotations

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns that names inside the operators could clash with.
CLASH = "key long, print long, id string, words string, n long, fp string, i int, start long, label int"


def documents(spark, rows):
    """A documents table of (doc_id, text) rows with clashing extra columns, in several partitions."""
    full = [(i, t, "en", "s", len(t or ""), 1, 2, "x", "y", 3, "z", 4, 5, 0) for i, t in rows]
    return spark.createDataFrame(full, f"{DOC}, {CLASH}").repartition(3)


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "word " * 3000), (6, "same text here now"), (7, "same text here now"),
    (7, "same text here now"), (None, "no id at all in this row"), (-8, "ünïcödé — ☃ 日本 text"), (9, "a" * 5000),
]
