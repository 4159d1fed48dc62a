"""Merkle manifest of a dataset: leaves by group under one root, with a proof for each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrial.sources.tables import SLICE, store, store_in_slices

FAN = 3
LEVELS = 7  # of a block, which holds FAN ** LEVELS nodes at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def leaf_digest(fields: Sequence[str | Column]) -> Column:
    """SHA-256 of the fields, each its length in bytes and its value, or ``-`` if missing."""
    written = []
    for field in fields:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        written.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*written), 256)


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``grp, width, rank, digest, below``: the place of every row in its group and the group's size.

    Rows are ordered by ``order`` (columns of ``below``), then by digest. They are stored in
    ordered slices; the rows of earlier slices enter the count of a slice as one marker row.
    ``tie`` only lets a run of equal rows span several slices.
    """
    place = F.struct(*[F.col(f"below.{c}").alias(f"k{i}") for i, c in enumerate(order)], "digest", "tie")
    sliced = store_in_slices(rows.withColumn("place", place), ["grp", "place"], "manifest-slices")
    counts = sliced.groupBy("grp", SLICE).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("grp").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    marks = counts.select(
        "grp", SLICE,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("step"),
        F.sum("n").over(Window.partitionBy("grp")).alias("width"),
    )
    both = sliced.select("*", F.lit(1).cast("long").alias("step")).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("grp", SLICE).orderBy(F.col("place").asc_nulls_first())
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.select("*", (F.sum("step").over(upto) - 1).alias("rank"), F.max("width").over(upto).alias("in_group"))
    return placed.filter("place is not null").select("grp", F.col("in_group").alias("width"), "rank", "digest", "below")


def _rolled_up(ranked: DataFrame, levels: int) -> DataFrame:
    """``grp, width, block, digest, below``: one row for each block of ``FAN ** levels`` ranks.

    The rank's digits are grouped away from the last to the first; each time the structs of
    a run are nested in their parent. All rows of a block meet in one shuffle. A level on
    which the group has a single node left hashes no more.
    """
    digits = [F.expr(f"cast(rank div {FAN**j} % {FAN} as int)").alias(f"d{j}") for j in range(levels)]
    block = F.expr(f"rank div {FAN**levels}").alias("block")
    nodes = ranked.select("grp", "width", block, *digits, "digest", "below").repartition("grp", "block")
    for j in range(levels):
        keys = ["grp", "width", "block", *[f"d{i}" for i in range(j + 1, levels)]]
        run = F.array_sort(F.collect_list(F.struct(F.col(f"d{j}").alias("d"), "digest", "below")))
        joined = F.sha2(F.array_join(F.col("kids.digest"), ""), 256)
        digest = F.when(F.col("width") > FAN**j, joined).otherwise(F.col("kids")[0]["digest"])
        nodes = nodes.groupBy(*keys).agg(run.alias("kids")).select(*keys, digest.alias("digest"), F.col("kids").alias("below"))
    return nodes


def _tree(rows: DataFrame, order: Sequence[str], levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored tiers of blocks over ``rows``, lowest first, and ``grp, digest`` of the tops."""
    ranked, tiers = _ranked(rows, order), []
    size = FAN**levels
    while True:
        tiers.append(store(_rolled_up(ranked, levels), "manifest-tier"))
        widest = tiers[-1].agg(F.max("width")).first()[0] or 0
        if widest <= size:
            return tiers, tiers[-1].select("grp", "digest")
        ranked = tiers[-1].selectExpr(
            "grp", f"(width + {size - 1}) div {size} as width", "block as rank", "digest", "block as below"
        )


def _descended(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """``grp, crown, path, below`` of everything under the blocks of ``tiers``.

    ``tops`` has ``grp, crown, path`` of each top. What lies above a block meets the block's
    nested struct in a grouping; a transform and an explode for each level then hand every
    node its siblings on top of the path of its parent.
    """
    over = tops.select("grp", F.lit(0).cast("long").alias("block"), "crown", "path")
    rows = over
    for tier in reversed(tiers):
        both = tier.drop("digest").unionByName(over, allowMissingColumns=True)
        parts = [F.first(c, ignorenulls=True).alias(c) for c in ("width", "below", "crown", "path")]
        rows = both.groupBy("grp", "block").agg(*parts)
        for j in reversed(range(levels)):
            step = (
                "named_struct('left', array_join(transform(slice(below, 1, i), x -> x.digest), ''), "
                f"'right', array_join(transform(slice(below, i + 2, {FAN}), x -> x.digest), ''))"
            )
            path = f"if(width > {FAN**j}, concat(array({step}), path), path)"
            node = F.expr(f"explode(transform(below, (c, i) -> named_struct('below', c.below, 'path', {path})))")
            rows = rows.select("grp", "width", "crown", node.alias("node")).select(
                "grp", "width", "crown", "node.path", "node.below"
            )
        over = rows.select("grp", F.col("below").alias("block"), "crown", "path")
    return rows


def proofs(
    leaves: DataFrame, group: str = "source", order: Sequence[str] = ("doc_id",), leaf: str = "leaf", levels: int = LEVELS
) -> DataFrame:
    """``leaves`` with ``subroot, root`` and ``proof`` of every row, instead of columns so named.

    In each group the leaves come in the order of the columns ``order``, missing values first,
    then of their digest. Every three consecutive nodes, fewer at the end, become the SHA-256
    of their digests one after another, until one is left, the subroot. Subroots in order of
    their group, the missing group first, become the root in the same way. ``proof`` is an
    array of ``left, right``, the digests beside the node on each level up to the root.

    Blocks of ``3 ** levels`` nodes are rolled up at a time, tier over tier, so no row holds
    more than a block, however large a group is. Rows equal in order and digest are leaves of
    their own; an empty table gives no rows.
    """
    kept = [F.col(f"`{c}`") for c in leaves.columns if c not in ("subroot", "root", "proof")]
    rows = leaves.select(
        F.col(group).alias("grp"), F.col(leaf).alias("digest"), F.struct(*kept).alias("below"),
        F.monotonically_increasing_id().alias("tie"),
    )
    tiers, tops = _tree(store(rows, "leaves"), order, levels)
    subroots = tops.select(
        F.lit(0).alias("grp"), "digest", F.struct("grp", "digest").alias("below"), F.lit(0).cast("long").alias("tie")
    )
    upper, top = _tree(store(subroots, "subroots"), ["grp"], levels)
    crowned = top.select("grp", F.array("digest").alias("crown"), F.array().cast(_STEPS).alias("path"))
    roots = _descended(upper, crowned, levels).select(
        "below.grp", F.concat(F.array("below.digest"), "crown").alias("crown"), "path"
    )
    found = _descended(tiers, store(roots, "roots"), levels)
    return found.select(
        "below.*", F.col("crown")[0].alias("subroot"), F.col("crown")[1].alias("root"), F.col("path").alias("proof")
    )


def folded(leaf: str, proof: str = "proof") -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(
        F.col(proof), F.col(leaf), lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256)
    )


def tampered_proofs(df: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of documents, and what the root becomes where line ends are lost.

    The leaf covers ``doc_id, source, lang, n_chars`` and ``text``. Documents with an even
    CRC-32 of their id are tampered with; a missing id or text is not. An empty text is a
    value of length 0 and differs from a missing one; repeated rows are leaves of their own.
    """
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    leaf = leaf_digest(FIELDS)
    leaves = df.select(
        "doc_id", "source", leaf.alias("leaf"),
        F.when(chosen, leaf_digest([*FIELDS[:-1], cut])).alias("altered"),
    )
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    found = proofs(leaves).withColumn("altered", F.coalesce("altered", "leaf"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded("altered").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle_tree(nodes: str, key: str, first: str) -> str:
    return (
        f"{nodes} AS ({first} UNION ALL SELECT {key}, max(lvl) + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), "
        f"(max(width) + 2) // 3 FROM {nodes} WHERE width > 1 GROUP BY {key}, pos // 3)"
    )


def _oracle_climb(climb: str, nodes: str, key: str, first: str) -> str:
    return (
        f"{climb} AS ({first} UNION ALL SELECT c.rid, c.{key}, c.lvl + 1, c.pos // 3, "
        "sha256(string_agg(CASE WHEN n.pos = c.pos THEN c.folded ELSE n.digest END, '' ORDER BY n.pos)), "
        "c.sibs || coalesce(string_agg(CASE WHEN n.pos <> c.pos THEN n.digest END, '' ORDER BY n.pos), '') "
        f"FROM {climb} AS c JOIN {nodes} AS n ON n.{key} IS NOT DISTINCT FROM c.{key} AND n.lvl = c.lvl "
        f"AND n.pos // 3 = c.pos // 3 WHERE n.width > 1 GROUP BY c.rid, c.{key}, c.lvl, c.pos, c.folded, c.sibs)"
    )


def _oracle() -> str:
    def field(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(x) for x in (*FIELDS[:-1], text)) + ")"

    crc = (  # CRC-32 by bytes of the decimal id: no such function in SQL, so a table of 256 entries
        "crc_table AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), "
        "lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) AS r(b)))"
    )
    check = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: "
        "CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a // 256, t[1 + xor(a % 256, x)])), 4294967295)"
    )
    cut = "replace(text, chr(10), '')"
    return f"""
WITH RECURSIVE {crc},
hashed AS (
  SELECT *, row_number() OVER () AS rid, {leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {check} % 2 = 0 THEN {leaf(cut)} ELSE {leaf('text')} END AS altered
  FROM documents, crc_table),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS width FROM hashed),
{_oracle_tree('nodes', 'source', 'SELECT source, 0 AS lvl, pos, leaf AS digest, width FROM leaves')},
sub AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
    count(*) OVER () AS width FROM nodes WHERE width = 1),
{_oracle_tree('crown', 'k', 'SELECT 0 AS k, 0 AS lvl, pos, subroot AS digest, width FROM sub')},
{_oracle_climb('climb', 'nodes', 'source', "SELECT rid, source, 0 AS lvl, pos, altered AS folded, '' AS sibs FROM leaves")},
risen AS (SELECT rid, source, arg_max(folded, lvl) AS folded, arg_max(sibs, lvl) AS sibs FROM climb GROUP BY rid, source),
{_oracle_climb('ascent', 'crown', 'k', 'SELECT r.rid, 0 AS k, 0 AS lvl, s.pos, r.folded, r.sibs FROM risen AS r JOIN sub AS s ON s.source IS NOT DISTINCT FROM r.source')},
done AS (SELECT rid, arg_max(folded, lvl) AS folded, arg_max(sibs, lvl) AS sibs FROM ascent GROUP BY rid)
SELECT l.doc_id, l.leaf, s.subroot, c.digest AS root, sha256(d.sibs) AS proof_sha256, d.folded AS folded_root,
  d.folded = c.digest AS verified
FROM leaves AS l JOIN done AS d USING (rid) JOIN sub AS s ON s.source IS NOT DISTINCT FROM l.source
JOIN crown AS c ON c.width = 1
"""


ORACLE = _oracle()
