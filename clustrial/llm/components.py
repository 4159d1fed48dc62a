"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clustrial.sources.tables import store

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least one: the larger neighbours, or the smaller and the node."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links`` (columns ``a`` and ``b``, whole numbers).

    The component is its least node. Large and small stars alternate until the links no
    longer change; each round is written to the shared folder, minima are taken on the map
    side, and no node's neighbours are gathered in one place. Links with a missing end and
    links of a node with itself are ignored.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, last = store(edges.distinct(), "links"), None
    for _ in range(MAX_ROUNDS):
        edges = _star(_star(edges, True).distinct(), False).distinct()
        seen = Observation()
        marks = [
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark"),
        ]
        edges = store(edges.observe(seen, *marks), "stars")
        now = (seen.get["n"], seen.get["mark"])
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
