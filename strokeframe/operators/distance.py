"""Distances between pixel sets, tiles and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def nearest_point(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` (keys, y, x, ...) with ``d``, the distance to the nearest point of ``b`` (keys, y, x) with equal keys.

    For points anywhere in the plane, a few for each key: a join on the keys and a minimum for each point. Points
    without any partner are left out.
    """
    other = b.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"))
    d = F.sqrt(((F.col("y") - F.col("_y")) ** 2 + (F.col("x") - F.col("_x")) ** 2).cast("double"))
    return a.join(other, keys).groupBy(*a.columns).agg(F.min(d).alias("d"))


def nearest(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """nearest_point() for pixels, whose places are whole numbers: one distance map for each key, in the order of its
    area and not of pairs of pixels. Pixels without any partner are left out."""
    schema = T.StructType([*a.schema.fields, T.StructField("d", T.DoubleType())])

    def measure(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if own.empty or other.empty:
            return own.iloc[:0].assign(d=np.zeros(0))
        p, q = own[["y", "x"]].to_numpy(np.int64), other[["_y", "_x"]].to_numpy(np.int64)
        low = np.minimum(p.min(axis=0), q.min(axis=0))
        h, w = np.maximum(p.max(axis=0), q.max(axis=0)) - low + 1
        at = p - low
        return own.assign(d=np.sqrt(squared_distances(q - low, h, w)[at[:, 0], at[:, 1]]))

    other = b.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "y", "x")])
    return a.groupBy(*keys).cogroup(other.groupBy(*[f"_{k}" for k in keys])).applyInPandas(measure, schema)


def nearest_cells(points: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, places y * w + x) of the nearest of ``points`` for an h x w grid, ties to the lowest place.

    As squared_distances(); distance and place are one number, so that the least of it settles both.
    """
    rows, columns, far = np.arange(h)[:, None], np.arange(w)[None, :], 4 * (h + w)
    on, cells = np.zeros((h, w), bool), h * w
    on[points[:, 0], points[:, 1]] = True
    above = np.maximum.accumulate(np.where(on, rows, -far), axis=0)
    below = np.minimum.accumulate(np.where(on, rows, far + h)[::-1], axis=0)[::-1]
    either = [(rows - r) ** 2 * cells + np.clip(r, 0, h - 1) * w + columns for r in (above, below)]
    column = np.minimum(*either)
    out = column.copy()
    for k in range(1, w):
        if k * k > out.max() // cells:
            break
        step = k * k * cells
        out[:, k:] = np.minimum(out[:, k:], column[:, :-k] + step)
        out[:, :-k] = np.minimum(out[:, :-k], column[:, k:] + step)
    return out // cells, out % cells


def nearest_pixel(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """nearest() with the place (ny, nx) of the nearest pixel, ties to the lowest ny, then nx."""
    schema = T.StructType([*a.schema.fields, T.StructField("d", T.DoubleType()), T.StructField("ny", T.LongType()), T.StructField("nx", T.LongType())])

    def measure(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if own.empty or other.empty:
            return own.iloc[:0].assign(d=np.zeros(0), ny=np.zeros(0, np.int64), nx=np.zeros(0, np.int64))
        p, q = own[["y", "x"]].to_numpy(np.int64), other[["_y", "_x"]].to_numpy(np.int64)
        low = np.minimum(p.min(axis=0), q.min(axis=0))
        h, w = np.maximum(p.max(axis=0), q.max(axis=0)) - low + 1
        at = p - low
        d, place = (m[at[:, 0], at[:, 1]] for m in nearest_cells(q - low, h, w))
        return own.assign(d=np.sqrt(d), ny=place // w + low[0], nx=place % w + low[1])

    other = b.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "y", "x")])
    return a.groupBy(*keys).cogroup(other.groupBy(*[f"_{k}" for k in keys])).applyInPandas(measure, schema)


def directed_chamfer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d): distances from a's pixels to b's, weighted by a's strength."""
    return nearest(a, b, keys).groupBy(*keys).agg((F.sum(F.col("strength") * F.col("d")) / F.sum("strength")).alias("d"))


def chamfer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cost): the mean of both directions; keys where either side is empty are left out."""
    there, back = directed_chamfer(a, b, keys), directed_chamfer(b, a, keys).withColumnRenamed("d", "e")
    return there.join(back, keys).select(*keys, ((F.col("d") + F.col("e")) / 2).alias("cost"))


def hausdorff(a: DataFrame, b: DataFrame, keys: list[str], by=nearest) -> DataFrame:
    """(keys, h): the larger of the two directed maxima of nearest distances; ``by``: nearest or nearest_point."""
    sides = [by(p, q, keys).groupBy(*keys).agg(F.max("d").alias("d")) for p, q in ((a, b), (b, a))]
    return sides[0].join(sides[1].withColumnRenamed("d", "e"), keys).select(*keys, F.greatest("d", "e").alias("h"))


def squared_distances(points: np.ndarray, h: int, w: int) -> np.ndarray:
    """Exact squared distances of an h x w grid to the nearest of ``points`` (y, x), at least one.

    Along columns by running extremes; along rows by shifts, up to the largest distance that is left.
    """
    rows = np.arange(h)[:, None]
    on, far = np.zeros((h, w), bool), 2 * (h + w)
    on[points[:, 0], points[:, 1]] = True
    above = np.maximum.accumulate(np.where(on, rows, -far), axis=0)
    below = np.minimum.accumulate(np.where(on, rows, far + h)[::-1], axis=0)[::-1]
    column = np.minimum(rows - above, below - rows) ** 2
    out = column.copy()
    for k in range(1, w):
        if k * k >= out.max():
            break
        out[:, k:] = np.minimum(out[:, k:], column[:, :-k] + k * k)
        out[:, :-k] = np.minimum(out[:, :-k], column[:, k:] + k * k)
    return out


def tile_maps(on: np.ndarray) -> np.ndarray:
    """squared_distances() of each of n grids (n, h, w), told by their masks, of which each has a pixel."""
    n, h, w = on.shape
    rows, far = np.arange(h, dtype=np.int32)[:, None], 2 * (h + w)
    above = np.maximum.accumulate(np.where(on, rows, -far), axis=1)
    below = np.minimum.accumulate(np.where(on, rows, far + h)[:, ::-1], axis=1)[:, ::-1]
    column = np.minimum(rows - above, below - rows).astype(np.int32) ** 2
    out = column.copy()
    for k in range(1, w):
        if k * k >= out.max(initial=0):
            break
        np.minimum(out[:, :, k:], column[:, :, :-k] + k * k, out=out[:, :, k:])
        np.minimum(out[:, :, :-k], column[:, :, k:] + k * k, out=out[:, :, :-k])
    return out


#: Places of the rasters that are laid out together, about.
PLACES = 1 << 17


def tiles_beside(pix: DataFrame, h: int, w: int, size: int, stride: int, places: int = PLACES) -> DataFrame:
    """(raster_id, ty, tx, cost, h): the tiles of ``size`` every ``stride`` pixels of each raster (raster_id, y, x, strength) against
    the next raster's at the same place: chamfer()'s and hausdorff()'s of their pixels. Tiles that are empty in either are left out.

    A task lays out a run of rasters, and the one after it; all rasters' tiles at one place are worked out together.
    """
    run = max(1, places // (h * w))
    spots = [(y, x) for y in range(0, max(h - size, 0) + 1, stride) for x in range(0, max(w - size, 0) + 1, stride)]
    names = ["raster_id", "ty", "tx", "cost", "h"]

    def measure(table: pa.Table) -> pa.Table:
        ids, own = np.unique(table.column("raster_id").to_numpy(), return_inverse=True)
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        there, strength = np.zeros((len(ids), h, w), bool), np.zeros((len(ids), h, w))
        there[own, y, x] = True
        strength[own, y, x] = table.column("strength").to_numpy()
        parts = [[np.zeros(0, np.int64), *[np.zeros(0, np.int32)] * 2, *[np.zeros(0)] * 2]]
        for ty, tx in spots:
            a, weight = (v[:, ty : ty + size, tx : tx + size] for v in (there, strength))
            filled = np.flatnonzero(a.any(axis=(1, 2)))
            a, weight = a[filled], weight[filled]
            first = np.flatnonzero(ids[filled][1:] == ids[filled][:-1] + 1)
            if len(first):
                d, whole = np.sqrt(tile_maps(a)), weight.sum(axis=(1, 2))
                ways = [(d[q] * a[p], weight[p], whole[p]) for p, q in ((first, first + 1), (first + 1, first))]
                forth, back = ((near * share).sum(axis=(1, 2)) / total for near, share, total in ways)
                most = np.maximum(*[near.max(axis=(1, 2)) for near, _, _ in ways])
                parts.append([ids[filled][first], np.full(len(first), ty, np.int32), np.full(len(first), tx, np.int32), (forth + back) / 2, most])
        return pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], names)

    low, high = F.floor(F.col("raster_id") / run), F.floor((F.col("raster_id") - 1) / run)
    inside = F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1) & F.col("strength").isNotNull()
    rows = pix.where(inside).select(*[F.col(c).cast("bigint").alias(c) for c in ("raster_id", "y", "x")], F.col("strength").cast("double").alias("strength"))
    # a stated number of partitions, as the work is not in the bytes by which adaptive plans join partitions
    parts = int(pix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where("raster_id IS NOT NULL").withColumn("run", F.explode(F.array_distinct(F.array(high, low)))).repartition(parts, "run")
    return dealt.groupBy("run").applyInArrow(measure, "raster_id bigint, ty int, tx int, cost double, h double")


def distance_map(points: np.ndarray, size: int) -> np.ndarray:
    """Exact distances of a size x size grid to the nearest of ``points`` (y, x)."""
    return np.sqrt(squared_distances(points, size, size))


def first_in_order(forth: np.ndarray, cost: np.ndarray) -> int:
    """The place that a scan in order ends at which leaves out what is no nearer one way than the least cost so far: not always
    the least cost, as the other way may be much nearer."""
    least, k, found = np.maximum(np.round(forth, 9), np.round(cost, 9)), 0, 0
    best = np.inf
    while k < len(least):
        ahead = np.flatnonzero(least[k:] < best)
        if not len(ahead):
            break
        found = k + int(ahead[0])
        best, k = round(float(cost[found]), 9), found + 1
    return found


def packed_tiles(pix: DataFrame, tiles: DataFrame) -> DataFrame:
    """(raster_id, y, x, strength, ty, tx): each raster's pixels and the places of its tiles (raster_id, ty, tx, ...) as arrays, those of
    the tiles in the order of the grid. Tiles' pixels are not told tile by tile, as one is in many tiles."""
    pixels = pix.where("y IS NOT NULL AND x IS NOT NULL AND strength IS NOT NULL").groupBy("raster_id").agg(
        *[F.collect_list(F.col(c).cast(t)).alias(c) for c, t in (("y", "int"), ("x", "int"), ("strength", "double"))]
    )
    places = tiles.groupBy("raster_id").agg(F.sort_array(F.collect_list(F.struct("ty", "tx"))).alias("t"))
    return pixels.join(places, "raster_id").select("raster_id", "y", "x", "strength", F.col("t.ty").alias("ty"), F.col("t.tx").alias("tx"))


def tile_arrays(y: np.ndarray, x: np.ndarray, strength: np.ndarray, ty: np.ndarray, tx: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, weights, distances) of a raster's tiles that have a pixel: a row each of (ty, tx), of shares of strength, and of distances to
    the nearest pixel."""
    # what is about the tiles is laid out too, so that each is a part of one array
    top, left = int(min(ty.min(), 0)), int(min(tx.min(), 0))
    high, wide = int(ty.max()) + size - top, int(tx.max()) + size - left
    there, laid = np.zeros((high, wide), bool), np.zeros((high, wide))
    inside = (y >= top) & (y < top + high) & (x >= left) & (x < left + wide)
    there[y[inside] - top, x[inside] - left] = True
    laid[y[inside] - top, x[inside] - left] = strength[inside]
    own = (ty - top)[:, None, None] + np.arange(size)[:, None], (tx - left)[:, None, None] + np.arange(size)[None, :]
    on = there[own]
    filled = np.flatnonzero(on.any(axis=(1, 2)))
    weight = laid[own][filled].reshape(len(filled), size * size)
    weight /= weight.sum(axis=1, keepdims=True)
    return np.stack([ty, tx], axis=1)[filled], weight, np.sqrt(tile_maps(on[filled])).reshape(len(filled), size * size)


def matrix(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(forth, cost): from the first's tiles to the second's, and the means of both ways, of two rasters' tile_arrays()."""
    forth = a[1] @ b[2].T
    return forth, (forth + a[2] @ b[1].T) / 2


#: Numbers of the tile arrays that a task holds, about.
HELD = 1 << 22


def _arrays(batch: pa.RecordBatch, row: int, side: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tile_arrays(*[batch.column(f"{c}_{side}")[row].values.to_numpy() for c in ("y", "x", "strength", "ty", "tx")], size)


def tile_pair_costs(pix: DataFrame, tiles: DataFrame, pairs: DataFrame, size: int, pick: str = "all") -> DataFrame:
    """(i, j, yi, xi, yj, xj, cost) for the tiles of ``size`` of the rasters of each pair (i, j), of which ``pick`` are told: "all" pairs of
    tiles, the "best" pair, the best tile of j for each of i ("arrival"), or the one pair that first_in_order() ends at ("first"), in the
    order of the grid; ties to 9 decimals go to the first.

    pix: (raster_id, y, x, strength); tiles: (raster_id, ty, tx, ...). A task gets both rasters' pixels with a pair, and lays them out
    itself; the arrays of the rasters that it had last are held. A pair then is two matrix products over its tiles.
    """
    made = packed_tiles(pix, tiles)
    side = lambda k: made.select(F.col("raster_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("y", "x", "strength", "ty", "tx")])

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            ends = [batch.column(k).to_pylist() for k in "ij"]
            for row, pair in enumerate(zip(*ends, strict=True)):
                for k, side in zip(pair, "ij", strict=True):
                    if k not in held:
                        held[k] = _arrays(batch, row, side, size)
                a, b = (held[k] for k in pair)
                while len(held) > 2 and sum(x[1].size for x in held.values()) > HELD:
                    held.pop(next(k for k in held if k not in pair))
                if not len(a[0]) or not len(b[0]):
                    continue
                forth, cost = matrix(a, b)
                rounded = np.round(cost, 9)
                if pick == "arrival":
                    at = np.arange(len(cost)) * cost.shape[1] + rounded.argmin(axis=1)
                elif pick == "all":
                    at = np.arange(cost.size)
                else:
                    at = np.array([rounded.argmin() if pick == "best" else first_in_order(forth.reshape(-1), cost.reshape(-1))])
                i, j = np.divmod(at, cost.shape[1])
                columns = [np.full(len(at), pair[0]), np.full(len(at), pair[1]), *[p[k, c].astype(np.int32) for p, k in ((a[0], i), (b[0], j)) for c in (0, 1)], cost.reshape(-1)[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "yi", "xi", "yj", "xj", "cost"])

    # few bytes, but much to work out: the number of partitions is stated, so that they are not joined
    parts = int(pix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = pairs.select("i", "j").join(side("i"), "i").join(side("j"), "j")
    # pairs of neighbours lie together, so that what is held is used again
    dealt = joined.repartition(parts, F.floor(F.col("i") / 64)).sortWithinPartitions("i", "j")
    return dealt.mapInArrow(costs, "i bigint, j bigint, yi int, xi int, yj int, xj int, cost double")


def cosine_distances(vectors: DataFrame, block: int = 256, within: str | None = None) -> DataFrame:
    """(i, j, d) for all i < j of (image_idx, vec): 1 - cosine, block by block as matrix products.

    The result is all pairs by definition, or all pairs with equal values of the column ``within``; use knn() where
    only neighbours are wanted.
    """
    return _blocks(vectors, block, lambda d, i, j, same: _upper(d, i, j), "i bigint, j bigint, d double", True, within)


def _upper(d: np.ndarray, i: np.ndarray, j: np.ndarray):
    a, b = np.nonzero(i[:, None] != j[None, :])
    low, high = np.minimum(i[a], j[b]), np.maximum(i[a], j[b])
    keep = i[a] < j[b] if np.intersect1d(i, j).size else np.ones(len(a), bool)
    return [low[keep], high[keep], d[a, b][keep]]


def _blocks(vectors: DataFrame, block: int, pick, schema: str, half: bool, within: str | None = None) -> DataFrame:
    """``pick`` applied to the distance matrix of each pair of blocks of vectors; ``half``: of each unordered pair;
    ``within``: of pairs with equal values of that column."""
    group = F.lit(0) if within is None else F.col(within)
    dealt = vectors.select(group.alias("g"), F.floor(F.col("image_idx") / block).alias("b"), F.struct("image_idx", F.col("vec").cast("array<double>").alias("vec")).alias("v"))
    packed = dealt.groupBy("g", "b").agg(F.collect_list("v").alias("v"))
    left, right = packed.select("g", F.col("b").alias("p"), F.col("v").alias("u")), packed.select(F.col("g").alias("h"), F.col("b").alias("q"), "v")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                u, v = batch.column("u")[r].as_py(), batch.column("v")[r].as_py()
                (i, x), (j, y) = ((np.array([e["image_idx"] for e in s]), np.array([e["vec"] for e in s])) for s in (u, v))
                x, y = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300) for z in (x, y))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in pick(1 - x @ y.T, i, j, None)], names)

    met = F.lit(True) if within is None else F.col("g") == F.col("h")
    pairs = left.join(right, met & (F.col("p") <= F.col("q")) if half else met)
    return pairs.repartition("g", "p", "q").select("u", "v").mapInArrow(run, schema)


def knn(vectors: DataFrame, k: int, block: int = 256, within: str | None = None) -> DataFrame:
    """(i, j, d, rank): the k nearest others of each vector by cosine distance, ties by index (to 12 decimals);
    ``within``: others with equal values of that column.

    Each pair of blocks keeps k of a row, so that k x blocks rows a vector reach the final ranking.
    """

    def pick(d: np.ndarray, i: np.ndarray, j: np.ndarray, _):
        d = np.round(np.where(i[:, None] == j[None, :], np.inf, d), 12)
        order = np.argsort(j)
        j, d = j[order], d[:, order]
        at = np.argsort(d, axis=1, kind="stable")[:, : min(k, d.shape[1])]
        rows = np.repeat(np.arange(len(i)), at.shape[1])
        at = at.reshape(-1)
        keep = np.isfinite(d[rows, at])
        return [i[rows][keep], j[at][keep], d[rows, at][keep]]

    near = _blocks(vectors, block, pick, "i bigint, j bigint, d double", False, within)
    rank = F.row_number().over(W.partitionBy("i").orderBy("d", "j"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def shortlist(neighbours: DataFrame) -> DataFrame:
    """(i, j), i < j: pairs of which one is among the other's neighbours."""
    return neighbours.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def combined(first: DataFrame, second: DataFrame, weight: float = 0.5) -> DataFrame:
    """(i, j, d): both distances over their maxima (if over 0), added with the weights 1 - ``weight`` and ``weight``."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        top = df.agg(F.max("d").alias("top"))
        return df.join(F.broadcast(top)).select("i", "j", F.when(F.col("top") > 0, F.col("d") / F.col("top")).otherwise(F.col("d")).alias(name))

    return scaled(first, "a").join(scaled(second, "b"), ["i", "j"]).select("i", "j", ((1 - weight) * F.col("a") + weight * F.col("b")).alias("d"))


def pair_fallback(costs: DataFrame, coarse: DataFrame, default_scale: float = 1.0, default_penalty: float = 100.0) -> DataFrame:
    """``coarse`` (i, j, d) with ``cost``: the pair's own (i, j, cost), else
    d * (median cost / median positive d) + the 90th percentile of costs; the median and percentile count each
    pair in both directions. Unmatched pairs are never stored: this is for the pairs that are asked for."""
    twice = costs.select("cost").unionByName(costs.select("cost"))
    stat = twice.agg(F.median("cost").alias("mc"), F.percentile("cost", 0.9).alias("p90"))
    positive = coarse.where("d > 0").agg(F.median("d").alias("md"))
    scale = F.coalesce(F.col("mc") / (F.col("md") + 1e-9), F.lit(default_scale))
    other = F.col("d") * scale + F.coalesce("p90", F.lit(default_penalty))
    # two tables of one row
    joined = coarse.join(costs, ["i", "j"], "left").join(F.broadcast(stat)).join(F.broadcast(positive))
    return joined.select("i", "j", F.coalesce("cost", other).alias("cost"))


def first_best(cost: str, *ties: str) -> Column:
    """An aggregate: the struct (cost, ties) that is least."""
    return F.min(F.struct(cost, *ties))
