"""Hard negatives from an R-tree packed by sort-tile-recursion (Leutenegger and others 1997).

Distinct vectors are dealt out by ranges of label and of the two coordinates that vary most, and each range is tiled
on, coordinate by coordinate, into leaves with bounding boxes. A box gives an interval for each coordinate's share of an
inner product, and so for the whole. An anchor takes boxes from a queue, the largest possible score first, and leaves out
those outside its score windows or strictly below its kth score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written
from .vectors import NO_ID, class_key, classes, finite, matrix, ranges, without_own

#: Rows of a leaf and children of a node at most; rows that are packed together, and anchors that search together, about.
LEAF, FANOUT = 256, 16
GROUP_ROWS, GROUP_ANCHORS = 8192, 1024

_LEAVES = "part int, first bigint, last bigint, labels array<bigint>, lo binary, hi binary, vectors binary, row_labels binary, ids array<bigint>, sizes array<int>"


def quantised(vector: Column, width: int) -> Column:
    """floor(256 x) of each component. Beyond a bound that no product of such vectors passes 2^53 with, the bound."""
    most = float(int((2.0**53 / max(width, 1)) ** 0.5))
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.greatest(F.least(x * 256.0, F.lit(most)), F.lit(-most))).cast("int"))


def _tiles(x: np.ndarray, rows: np.ndarray, axes: list[int]) -> Iterator[np.ndarray]:
    """The leaves of ``rows``: slabs of equal size along the first axis, each tiled along the next ones."""
    pages = -(-len(rows) // LEAF)
    if pages <= 1 or not axes:
        yield from (rows[i : i + LEAF] for i in range(0, len(rows), LEAF))
        return
    slabs = max(2, int(np.ceil(pages ** (1 / len(axes)))))
    rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
    size = -(-pages // slabs) * LEAF
    for i in range(0, len(rows), size):
        yield from _tiles(x, rows[i : i + size], axes[1:])


def _leaf_rows(x: np.ndarray, labels: np.ndarray, axes: list[int]) -> Iterator[np.ndarray]:
    """Leaves of one label where it has many rows; rows of rare labels share leaves."""
    order = np.argsort(labels, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(labels[order])) + 1, len(order))
    held, start = [], 0
    for end in ends:
        if end - start >= LEAF // 4:
            yield from _tiles(x, order[start:end], axes)
        else:
            held.append(order[start:end])
            if sum(map(len, held)) >= LEAF // 2:
                yield np.concatenate(held)
                held = []
        start = end
    if held:
        yield np.concatenate(held)


def pack(found: DataFrame, width: int, n: int) -> DataFrame:
    """One row for each leaf of the tree over ``found`` (label, vector, ids): its labels, box, vectors and ids."""
    spread = found.select(F.posexplode("vector").alias("axis", "x")).groupBy("axis").agg(F.var_pop("x").alias("v")).collect()  # ``width`` rows
    axes = [r["axis"] for r in sorted(spread, key=lambda r: (-r["v"], r["axis"]))]
    parts = max(1, -(-n // GROUP_ROWS))
    ordered = [F.coalesce(F.try_element_at("vector", F.lit(a + 1)), F.lit(0)) for a in axes[:2]] or [F.lit(0)]
    slabs = max(1, int(parts**0.5))
    slabbed = found.repartitionByRange(slabs, ordered[0], F.col("key")).withColumn("slab", F.spark_partition_id())
    # the key last: many rows share a label and the values of a coordinate
    dealt = slabbed.repartitionByRange(parts, F.col("label"), F.col("slab"), ordered[-1], F.col("key"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            x, labels = matrix(table.column("vector"), width), table.column("label").to_numpy()
            ids, off = ranges(table.column("ids"))
            out = []
            for rows in _leaf_rows(x, labels, axes[2:] or axes):
                v = x[rows].astype(np.int32)
                out.append((
                    part, labels[rows].min(), labels[rows].max(), np.unique(labels[rows]), v.min(axis=0).tobytes(), v.max(axis=0).tobytes(), v.tobytes(),
                    labels[rows].astype(np.int64).tobytes(), np.concatenate([ids[off[r] : off[r + 1]] for r in rows]), off[rows + 1] - off[rows],
                ))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["part", "first", "last", "labels", "lo", "hi", "vectors", "row_labels", "ids", "sizes"]
            return pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

        for b in batches:
            for i in range(0, b.num_rows, GROUP_ROWS):
                if sum(x.num_rows for x in held) >= GROUP_ROWS:
                    yield packed()
                    held = []
                held.append(b.slice(i, GROUP_ROWS))
        if held:
            yield packed()

    return dealt.select("label", "vector", "ids").mapInArrow(leaves, _LEAVES)


class Tree:
    """The leaves of one group with boxes of boxes above them."""

    def __init__(self, leaves: pa.Table, width: int):
        def blobs(name: str, kind: type) -> list[np.ndarray]:
            return [np.frombuffer(v, kind) for v in leaves.column(name).to_pylist()]

        def boxes(name: str) -> np.ndarray:
            return np.array(blobs(name, np.int32), np.float64).reshape(leaves.num_rows, width)

        self.vectors = [v.reshape(-1, width).astype(np.float64) for v in blobs("vectors", np.int32)]
        self.labels = blobs("row_labels", np.int64)
        ids, off = ranges(leaves.column("ids"))
        self.ids = [ids[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        sizes, cut = ranges(leaves.column("sizes"))
        self.offsets = [np.concatenate([[0], np.cumsum(sizes[a:b])]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.least = [i[o[:-1]] for i, o in zip(self.ids, self.offsets, strict=True)]
        # level by level, the boxes of up to FANOUT neighbours together
        lo, hi, first, last = boxes("lo"), boxes("hi"), leaves.column("first").to_numpy(), leaves.column("last").to_numpy()
        self.lo, self.hi, self.first, self.last, self.children = lo, hi, first, last, [range(0)] * len(lo)
        at = 0
        while len(lo) > 1:
            cuts = np.arange(0, len(lo), FANOUT)
            self.children += [range(at + c, at + min(c + FANOUT, len(lo))) for c in cuts]
            at += len(lo)
            lo, hi, first, last = np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)
            self.lo, self.hi = np.concatenate([self.lo, lo]), np.concatenate([self.hi, hi])
            self.first, self.last = np.concatenate([self.first, first]), np.concatenate([self.last, last])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, nodes): the least and the greatest inner product with any point of each box, exactly."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.lo.T + down @ self.hi.T, up @ self.hi.T + down @ self.lo.T

    def rows(self, leaf: int, row: int) -> np.ndarray:
        """The ids of a leaf's row."""
        return self.ids[leaf][self.offsets[leaf][row] : self.offsets[leaf][row + 1]]

    def search(self, anchor: np.ndarray, label: int, same: bool, least: np.ndarray, most: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[list[tuple]]:
        """For each window (low, high) of scores the best ``k`` rows (score, id, leaf, row) in it, of the same label or of others."""
        found: list[list[tuple]] = [[] for _ in windows]
        lows, highs = np.array([w[0] for w in windows]), np.array([w[1] for w in windows])
        floors = lows.copy()  # a window's kth score, once it has k rows
        queue = [(-most[-1], len(most) - 1)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floors.min():
                break  # so are all that are still in the queue
            useful = (floors <= -bound) & (highs >= least[node])
            if not useful.any() or (same and not self.first[node] <= label <= self.last[node]) or (not same and self.first[node] == label == self.last[node]):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-most[child], child))
                continue
            score = self.vectors[node] @ anchor
            fits = (self.labels[node] == label) == same
            hit = fits & (score >= floors.min()) & (score <= highs.max())
            if not hit.any():
                continue
            at = np.flatnonzero(hit)
            for w in range(len(windows)):
                mine = at[(score[at] >= floors[w]) & (score[at] <= highs[w])]
                if len(mine):
                    mine = mine[np.lexsort((self.least[node][mine], -score[mine]))[:k]]
                    new = [(-score[r], i, node, r) for r in mine for i in self.rows(node, r)]
                    found[w] = sorted(found[w] + new, key=lambda x: x[:2])[:k]
                    if len(found[w]) == k:
                        floors[w] = max(floors[w], -found[w][-1][0])
        return found


def _in_groups(leaves: DataFrame, anchors: DataFrame, search, schema: str) -> DataFrame:
    """``search`` on each part of the tree with each block of the anchors that have this part among their ``parts``.

    The anchors are the stated queries; a part and a block are bounded, and meet once.
    """
    blocks = max(1, -(-anchors.count() // GROUP_ANCHORS))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    left = leaves.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.select("*", block).withColumn("part", F.explode("parts")).drop("parts")
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(search, schema)


def mine(rows: DataFrame, asks: str, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each of ``rows`` (vec_id, label,
    embedding) that fulfils the condition ``asks`` on vec_id.

    A row's score is the inner product of its and the anchor's components, each floor(256 x). The positives are the anchor's
    first ``positives`` other rows of its label; the negatives of each are the first ``negatives`` rows of other labels
    with a score from low to high (fractions) of the positive's. Higher scores come first, ties by the smaller vec_id, null last.

    Rows with a null label, a null vector, or null or non-finite components take no part. A shorter vector, or an empty
    one, counts as filled up with zeros. Rows that repeat a vec_id are rows of their own. Components are cut where products could pass 2^53
    (at 64 components, beyond 46,000). Equal vectors of one label are searched once; 2^63 - 1 stands for a null vec_id. Other columns take no part. An empty table gives
    no rows.
    """
    real = rows.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("v"))
    real = real.where(F.col("label").isNotNull() & finite(F.col("v").cast("array<double>")))
    width = real.agg(F.max(F.size("v"))).first()[0] or 1
    real = real.select("id", "label", quantised(F.col("v"), width).alias("vector"))
    stored = written(classes(real, ["label", "vector"], positives + 1), "negatives-classes")
    wants = real.where(F.expr(asks.replace("vec_id", "id")))
    name = class_key(F.col("label"), F.col("vector")).alias("key")
    anchors = written(wants.select("label", "vector").distinct().select(name, "label", "vector"), "negatives-anchors")
    n = stored.count()
    packed = written(pack(stored, width, n), "negatives-leaves")
    # neighbouring partitions search together, so that a part has about GROUP_ROWS rows however many partitions there are
    parts, last = max(1, -(-n // GROUP_ROWS)), packed.agg(F.max("part")).first()[0] or 0
    leaves = packed.withColumn("part", F.floor(F.col("part") * F.lit(parts) / F.lit(last + 1)).cast("int"))
    having = leaves.select("part", F.explode("labels").alias("label")).distinct().groupBy("label").agg(F.collect_list("part").alias("parts"))

    def each(tree_of: pa.Table, asking: pa.Table) -> Iterator[tuple[Tree, int, np.ndarray, np.ndarray, np.ndarray, int]]:
        tree, x, labels = Tree(tree_of, width), matrix(asking.column("vector"), width), asking.column("label").to_numpy()
        for i in range(0, len(x), 256):
            least, most = tree.bounds(x[i : i + 256])
            for k in range(len(least)):
                yield tree, i + k, x[i + k], least[k], most[k], int(labels[i + k])

    def closest(tree_of: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        for tree, i, a, least, most, label in each(tree_of, asking) if tree_of.num_rows else ():
            for s, id_, leaf, row in tree.search(a, label, True, least, most, [(-np.inf, np.inf)], positives + 1)[0]:
                out.append((i, int(-s), id_, bool((tree.vectors[leaf][row] == a).all())))
        at, score, ids, own = zip(*out, strict=True) if out else ((), (), (), ())
        names = asking.column("key").combine_chunks()
        return pa.table({"key": names.take(pa.array(at, pa.int64())), "score": pa.array(score, pa.int64()), "id": pa.array(ids, pa.int64()), "own": pa.array(own, pa.bool_())})

    def hard(tree_of: pa.Table, asking: pa.Table) -> pa.Table:
        out, wanted = [], asking.column("scores").to_pylist()
        for tree, i, a, least, most, label in each(tree_of, asking) if tree_of.num_rows else ():
            windows = [(-(-p * low[0] // low[1]), p * high[0] // high[1]) for p in wanted[i]]
            got = tree.search(a, label, False, least, most, windows, negatives)
            out += [(i, p, int(-s), id_) for p, found in zip(wanted[i], got, strict=True) for s, id_, _, _ in found]
        at, positive, score, ids = zip(*out, strict=True) if out else ((), (), (), ())
        names = asking.column("key").combine_chunks()
        return pa.table({"key": names.take(pa.array(at, pa.int64())), "positive": pa.array(positive, pa.int64()), "score": pa.array(score, pa.int64()), "id": pa.array(ids, pa.int64())})

    near = _in_groups(leaves, anchors.join(having, "label"), closest, "key string, score bigint, id bigint, own boolean")
    first = W.partitionBy("key").orderBy(F.col("score").desc(), "id", F.col("own").desc())
    best = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives + 1)
    best = written(best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id", "own"))).alias("found")), "negatives-positives")
    scores = F.array_distinct(F.filter(F.transform("found", lambda x: x["score"]), lambda s: s >= 0))  # no window fits below 0
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    wanted = anchors.join(best.select("key", scores.alias("scores")), "key").where(F.size("scores") > 0).withColumn("parts", every)
    far = _in_groups(leaves, wanted, hard, "key string, positive bigint, score bigint, id bigint")
    first = W.partitionBy("key", "positive").orderBy(F.col("score").desc(), "id")
    kept = far.withColumn("place", F.row_number().over(first)).where(F.col("place") <= negatives)
    kept = kept.groupBy("key").agg(F.collect_list(F.struct("positive", "place", "score", "id")).alias("negatives"))
    answers = written(best.join(kept, "key"), "negatives-answers")
    asking = wants.select(F.col("id").alias("anchor_id"), name)
    own = F.transform("found", lambda x: x["own"] & (x["id"] == F.col("anchor_id")))
    out = asking.join(answers, "key").select("anchor_id", "negatives", F.explode(F.slice(without_own(F.col("found"), own), 1, positives)).alias("p"))
    out = out.select("anchor_id", "p", F.explode(F.filter("negatives", lambda x: x["positive"] == F.col("p.score"))).alias("x"))
    return out.select(
        "anchor_id", F.nullif("p.id", F.lit(NO_ID)).alias("positive_id"), F.col("x.place").alias("rank"), F.nullif("x.id", F.lit(NO_ID)).alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"),
    )
