"""Merkle manifest of a dataset: a tree of hashes over each group's rows, and one over the groups' roots.

Rows are numbered within their group by one range shuffle. The levels of a tree are worked out in blocks of
2^LEVELS consecutive nodes, which no run of two crosses: per level, lag and lead at the fixed offset 2^level, masked
by the slot's bits and by the run's length, supply siblings, and the rows of first children hash the parents. A
block's root is a node of the next round, of which there are log(n) / LEVELS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

#: Levels of one round; a block has 2^LEVELS rows.
LEVELS = 10
#: Rows of a range, about.
RANGE_ROWS = 1 << 16

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the concatenated texts; no part may be null."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """``rows`` with ``place``: 0, 1, ... in ``order`` (nulls first) over the whole table, by one shuffle into ranges.

    Rows that are equal in ``order`` are spread over ranges too: their place in the input breaks the tie. Only a count
    for each range comes together in one task.
    """
    by = [*[F.col(c).asc_nulls_first() for c in order], F.col("_seq")]
    seq = rows.withColumn("_seq", F.monotonically_increasing_id())
    at = F.monotonically_increasing_id()  # range << 33 | place in the range
    sorted_ = written(seq.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("_seq").withColumn("_at", at), "merkle-ranges")
    counts = sorted_.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    here = F.col("_at").bitwiseAND((1 << 33) - 1)
    # as many rows as ranges, two longs each
    joined = sorted_.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range")
    return joined.withColumn("place", F.col("_start") + here).drop("_range", "_start", "_at")


def _round(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (group, slot, n, node) with ``path``, the siblings of each of the round's levels from below, and, as
    ``node``, on the rows of first children the block's root.

    An entry of ``path`` is ``<`` or ``>`` and the sibling on the left or right, ``=`` where a run has one node, or
    null where the group has its root already.
    """
    # a column of its own, so that one shuffle serves all levels
    out = nodes.withColumn("_block", F.shiftright("slot", levels))
    block = W.partitionBy("group", "_block").orderBy("slot")
    running = block.rowsBetween(W.unboundedPreceding, 0)
    for level in range(levels):
        step = 1 << level
        first = F.col("slot").bitwiseAND(step - 1) == 0  # the row stands for a node of this level
        right = F.col("slot").bitwiseAND(step) != 0
        grows = F.col("n") > step  # more than one node remains
        beside = F.lead("node", step).over(block)
        out = out.withColumn("_before", F.lag("node", step).over(block)).withColumn("_after", F.when(F.col("slot") + step < F.col("n"), beside))
        sibling = (
            F.when(right, F.concat(F.lit("<"), "_before"))
            .when(F.col("_after").isNotNull(), F.concat(F.lit(">"), "_after"))
            .otherwise(F.lit("="))
        )
        parent = F.when(F.col("_after").isNotNull(), digest(F.col("node"), F.col("_after"))).otherwise(digest(F.col("node")))
        out = (
            out.withColumn("_sibling", F.when(first & grows, sibling))
            # the last row before it, or itself, that stands for a node is a row's own ancestor
            .withColumn(f"_path{level}", F.when(grows, F.last("_sibling", ignorenulls=True).over(running)))
            .withColumn("node", F.when(first & ~right & grows, parent).otherwise(F.col("node")))
        )
    path = F.filter(F.array(*[F.col(f"_path{level}") for level in range(levels)]), lambda s: s.isNotNull())
    return out.select(*nodes.columns, path.alias("path"))


def climb(leaves: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Of ``leaves`` (group, slot, n, node and others), with up to ``most`` to a group: the leaves with ``path``, and
    (group, root)."""
    others = [c for c in leaves.columns if c not in ("n", "node")]
    rounds, nodes = [], leaves
    while True:
        levels = min(LEVELS, max(1, (most - 1).bit_length()))
        done = written(_round(nodes, levels), name)
        rounds.append((done, levels))
        nodes = done.where(F.col("slot").bitwiseAND((1 << levels) - 1) == 0).select(
            "group", F.shiftright("slot", levels).alias("slot"), F.ceil(F.col("n") / (1 << levels)).cast("bigint").alias("n"), "node"
        )
        most = -(-most >> levels) if most > 0 else 0
        if most <= 1:
            break
    whole = rounds[-1][0]
    for done, levels in rounds[-2::-1]:
        above = whole.select("group", F.col("slot").alias("_block"), F.col("path").alias("_above"))
        whole = done.withColumn("_block", F.shiftright("slot", levels)).join(above, ["group", "_block"]).withColumn("path", F.concat("path", "_above"))
    return whole.select(*others, "path"), nodes.select("group", F.col("node").alias("root"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""

    def step(node: Column, s: Column) -> Column:
        side, sibling = F.substring(s, 1, 1), F.substring(s, 2, 64)
        return F.sha2(F.when(side == "<", F.concat(sibling, node)).when(side == ">", F.concat(node, sibling)).otherwise(node).cast("binary"), 256)

    return F.aggregate(path, leaf, step)


def manifest(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(``order``, leaf, subroot, root, proof_sha256, tampered_leaf, path) for each of ``rows``, which has columns ``group``,
    ``order``, ``leaf`` and ``tampered_leaf`` (hex digests; the last may be null).

    Groups are ordered by value, null first; leaves by ``order``, null first, then by ``leaf``. Equal rows are leaves
    of their own. ``proof`` is the digest of the siblings alone, from the leaf to the root. No rows give no rows.
    """
    n = rows.count()
    given = rows.select(F.col(group).alias("_g"), F.col(order).alias("_o"), "leaf", "tampered_leaf")
    placed = numbered(given, ["_g", "_o", "leaf"], max(1, -(-n // RANGE_ROWS)))
    sizes = written(placed.groupBy("_g").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("n")), "merkle-sizes")
    count, most = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    groups = written(numbered(sizes, ["_g"], max(1, -(-count // RANGE_ROWS))).withColumnRenamed("place", "group"), "merkle-groups")
    # so few groups as languages are broadcast by Spark, which knows their written size; many are joined
    joined = placed.join(groups.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h")))
    leaves = joined.select("_o", "leaf", "tampered_leaf", "group", (F.col("place") - F.col("_first")).alias("slot"), "n", F.col("leaf").alias("node"))
    paths, subroots = climb(leaves, most or 0, "merkle-nodes")
    tops = subroots.select(F.lit(0).cast("bigint").alias("group"), F.col("group").alias("slot"), F.lit(count).cast("bigint").alias("n"), F.col("root").alias("node"))
    above, root = climb(tops, count, "merkle-roots")
    ends = above.join(F.broadcast(root), "group").select(F.col("slot").alias("group"), F.col("path").alias("_above"), "root")
    ends = written(ends.join(subroots.withColumnRenamed("root", "subroot"), "group"), "merkle-ends")
    whole = paths.join(ends, "group").withColumn("path", F.concat("path", "_above"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)
    return whole.select(F.col("_o").alias(order), "leaf", "subroot", "root", proof.alias("proof_sha256"), "tampered_leaf", "path")


def document_leaf(n_chars: Column | None = None) -> Column:
    """The leaf of a row of documents, of its five fields in order; ``n_chars`` may stand in for the column."""
    return digest(*[field(n_chars if c == "n_chars" and n_chars is not None else F.col(c)) for c in _FIELDS])


def verify_documents(docs: DataFrame, tampers: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: where ``tampers``, the leaf that is
    folded has one more in n_chars.

    A null field counts as ``-``, a null n_chars stays null; a row without doc_id comes first in its language. Texts
    are hashed whole, and only digests are shuffled. Rows that are equal in all fields are leaves side by side, and
    other columns, whatever their names, take no part. An empty table gives no rows.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    leaf = document_leaf()
    rows = docs.select(*_FIELDS).select("doc_id", "lang", leaf.alias("leaf"), F.when(tampers & F.col("n_chars").isNotNull(), document_leaf(more)).alias("tampered_leaf"))
    made = manifest(written(rows, "merkle-hashes"), "lang", "doc_id")
    made = made.withColumn("folded_root", fold(F.coalesce("tampered_leaf", "leaf"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
