"""Sparse rasters as rows (raster_id, y, x, strength): stencils, thresholds, boundaries, tiles.

Stencils are worked on in square blocks, with the pixels about them: one shuffle of the pixels, no self-join. A pixel without a
row has strength 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strokeframe.tables import written

from . import drawings
from .links import roots

PIXEL = ["raster_id", "y", "x"]
NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
#: Fixed values of the published kernels: horizontal derivatives; the vertical ones are their transposes.
SOBEL = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SCHARR = [[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]]
#: Sides of the square blocks that a large raster is worked on in, in pixels.
BLOCK = 512


def edges(pix: DataFrame, threshold: float) -> DataFrame:
    """The pixels of at least ``threshold``; null strengths are none."""
    return pix.where(F.col("strength") >= threshold)


def block_of(y: Column, x: Column, w: int, side: int) -> Column:
    """The number of the square block of a raster ``w`` pixels wide that holds a pixel."""
    return F.floor(y / side) * (-(-w // side)) + F.floor(x / side)


def with_halo(pix: DataFrame, h: int, w: int, side: int, halo: int = 1) -> DataFrame:
    """Rows of ``pix`` with ``block``, and once more for each other block that they are no farther than ``halo`` from."""
    if h <= side and w <= side:
        return pix.withColumn("block", F.lit(0).cast("bigint"))
    across, down = -(-w // side), -(-h // side)
    near = [F.array_distinct(F.array(*[F.least(F.greatest(F.floor((F.col(c) + k) / side), F.lit(0)), F.lit(n - 1)) for k in (-halo, 0, halo)])) for c, n in (("y", down), ("x", across))]
    blocks = F.flatten(F.transform(near[0], lambda y: F.transform(near[1], lambda x: y * across + x)))
    return pix.withColumn("block", F.explode(blocks))


def in_blocks(pix: DataFrame, columns: list[str], schema: str, h: int, w: int, side: int, kernel: Callable) -> DataFrame:
    """``kernel`` over each block of a raster with a halo of one pixel, in one task: it gets the mask of pixels and the dense
    arrays of ``columns`` (0 where there is none), two wider than the block, and gives the mask and the columns of the
    inner places that are rows of the result (raster_id, y, x, ...)."""
    names = [c.split()[0] for c in schema.split(", ")]
    across = -(-w // side)

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        top, left = block // across * side, block % across * side
        high, wide = min(side, h - top), min(side, w - left)
        y, x = (table.column(c).to_numpy() - o + 1 for c, o in (("y", top), ("x", left)))
        inside = (y >= 0) & (y < high + 2) & (x >= 0) & (x < wide + 2)
        there = np.zeros((high + 2, wide + 2), bool)
        there[y[inside], x[inside]] = True
        dense = []
        for c in columns:
            layer = np.zeros(there.shape)
            layer[y[inside], x[inside]] = table.column(c).to_numpy()[inside]
            dense.append(layer)
        kept, made = kernel(there, *dense)
        at, beside = np.nonzero(kept)
        arrays = [pa.array(np.full(len(at), table.column("raster_id")[0].as_py())), pa.array(at + top), pa.array(beside + left), *[pa.array(m[kept]) for m in made]]
        return pa.Table.from_arrays(arrays, names)

    rows = pix.select(*[F.col(c).cast("bigint").alias(c) for c in PIXEL], *[F.col(c).cast("double").alias(c) for c in columns])
    return with_halo(rows, h, w, side).groupBy("raster_id", "block").applyInArrow(run, schema)


def scatter(pix: DataFrame, kernels: dict[str, list[list[float]]], h: int, w: int, side: int = BLOCK) -> DataFrame:
    """(raster_id, y, x, one column for each kernel): 3x3 correlations with zero padding, where not all are empty. A block of a
    raster, with the pixels about it, is a task."""

    def kernel(there: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        high, wide = there.shape[0] - 2, there.shape[1] - 2
        shifted = [(a, b, strength[a : a + high, b : b + wide]) for a in range(3) for b in range(3)]
        reached = np.logical_or.reduce([there[a : a + high, b : b + wide] for a in range(3) for b in range(3)])
        return reached, [sum(float(k[a][b]) * part for a, b, part in shifted if k[a][b]) for k in kernels.values()]

    return in_blocks(pix, ["strength"], ", ".join(["raster_id bigint", "y bigint", "x bigint", *[f"{n} double" for n in kernels]]), h, w, side, kernel)


def gradients(pix: DataFrame, kernel: list[list[float]], h: int, w: int) -> DataFrame:
    """(raster_id, y, x, gx, gy, mag); derivatives in steps of 1e-9, so that what cancels out is 0 in any order of adding."""
    flipped = [list(r) for r in zip(*kernel, strict=True)]
    found = scatter(pix, {"gx": kernel, "gy": flipped}, h, w)
    return found.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("gx", "gy")}).withColumn("mag", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def sobel_strength(pix: DataFrame, h: int, w: int) -> DataFrame:
    """(raster_id, y, x, value): the mean of the absolute derivatives, squared."""
    g = gradients(pix, SOBEL, h, w)
    mean = (F.abs("gx") + F.abs("gy")) / 2
    return g.select(*PIXEL, (mean * mean).alias("value"))


def normalised_strength(g: DataFrame, value: str = "mag") -> DataFrame:
    """Adds ``norm``: the value over its raster's maximum, 0 if that is 0."""
    top = F.max(value).over(W.partitionBy("raster_id"))
    return g.withColumn("norm", F.when(top > 0, F.col(value) / top).otherwise(F.lit(0.0)))


def thin(g: DataFrame, h: int, w: int, side: int = BLOCK) -> DataFrame:
    """Non-maximum suppression of (raster_id, y, x, gx, gy, mag): rows at least as strong as both neighbours along
    the gradient's sector (0, 45, 90, 135 degrees). A block of a raster, with the pixels about it, is a task."""

    def kernel(there: np.ndarray, gx: np.ndarray, gy: np.ndarray, mag: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        high, wide = there.shape[0] - 2, there.shape[1] - 2
        gx, gy, own = (v[1:-1, 1:-1] for v in (gx, gy, mag))
        angle = np.round(np.degrees(np.arctan2(gy, gx)) % 180, 9)
        sector = np.select([(angle >= 22.5) & (angle < 67.5), (angle >= 67.5) & (angle < 112.5), (angle >= 112.5) & (angle < 157.5)], [1, 2, 3], 0)
        rounded = np.round(mag, 9)
        beside = [np.maximum(rounded[1 + dy : 1 + dy + high, 1 + dx : 1 + dx + wide], rounded[1 - dy : 1 - dy + high, 1 - dx : 1 - dx + wide]) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
        kept = there[1:-1, 1:-1] & (np.round(own, 9) >= np.choose(sector, beside))
        return kept, [gx, gy, own]

    return in_blocks(g, ["gx", "gy", "mag"], "raster_id bigint, y bigint, x bigint, gx double, gy double, mag double", h, w, side, kernel)


def outer_boundary(pix: DataFrame, h: int, w: int) -> DataFrame:
    """(raster_id, y, x) of inner background pixels with both foreground and background among their 8 neighbours."""
    around = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in NEIGHBOURS])
    near = pix.select("raster_id", F.explode(around).alias("t")).groupBy("raster_id", F.col("t.y").alias("y"), F.col("t.x").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    inner = near.where((F.col("y") > 0) & (F.col("y") < h - 1) & (F.col("x") > 0) & (F.col("x") < w - 1) & (F.col("n") < 8))
    return inner.join(pix.select(*PIXEL), PIXEL, "left_anti").select(*PIXEL)


def tile_grid(rasters: DataFrame, size: Column, stride: int) -> DataFrame:
    """(raster_id, ty, tx, ts): tiles of ``size`` on a raster (raster_id, h, w) every ``stride`` pixels; (0, 0) if none fits."""
    t = rasters.withColumn("ts", size.cast("int"))

    def starts(n: str) -> Column:
        return F.when(F.col("ts") <= F.col(n), F.sequence(F.lit(0), F.col(n) - F.col("ts"), F.lit(stride))).otherwise(F.array().cast("array<int>"))

    grid = F.flatten(F.transform(starts("h"), lambda y: F.transform(starts("w"), lambda x: F.struct(y.alias("ty"), x.alias("tx")))))
    alone = F.array(F.struct(F.lit(0).alias("ty"), F.lit(0).alias("tx")))
    return t.select("raster_id", "ts", F.explode(F.when(F.size(grid) > 0, grid).otherwise(alone)).alias("t")).select("raster_id", "t.ty", "t.tx", "ts")


def tile_grids(rasters: DataFrame, ratios: list[float], stride: int, least: int = 16) -> DataFrame:
    """Tiles of several ratios of the shorter side; sizes under ``least`` or over the raster are left out, and a
    raster with none gets one in its middle."""
    short = F.least("h", "w")
    sized = rasters.withColumn("size", F.explode(F.array_distinct(F.array(*[F.floor(short * r + 1e-9).cast("int") for r in ratios]))))
    fit = sized.where((F.col("size") >= least) & (F.col("size") <= short))
    grid = tile_grid(fit, F.col("size"), stride)
    bare = rasters.join(fit.select("raster_id").distinct(), "raster_id", "left_anti")
    ts = F.greatest(F.lit(least), F.least(F.floor(short * ratios[0] + 1e-9).cast("int"), F.col("h"), F.col("w")))
    centre = bare.select("raster_id", F.floor((F.col("h") - ts) / 2).cast("int").alias("ty"), F.floor((F.col("w") - ts) / 2).cast("int").alias("tx"), ts.alias("ts"))
    return grid.unionByName(centre)


def tile_pixels(pix: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rows of ``tiles`` with each pixel inside: y, x relative to the tile, and strength."""
    inside = (F.col("y") >= F.col("ty")) & (F.col("y") < F.col("ty") + F.col("ts")) & (F.col("x") >= F.col("tx")) & (F.col("x") < F.col("tx") + F.col("ts"))
    return tiles.join(pix, "raster_id").where(inside).select(*tiles.columns, (F.col("y") - F.col("ty")).alias("y"), (F.col("x") - F.col("tx")).alias("x"), "strength")


def dense_tiles(pix: DataFrame, tiles: DataFrame, threshold: float = 0.1, density: float = 0.01) -> DataFrame:
    """Tiles with at least ``density`` of their pixels above ``threshold``, with n and weight of those."""
    strong = tile_pixels(pix.where(F.col("strength") > threshold), tiles)
    return strong.groupBy(*tiles.columns).agg(F.count(F.lit(1)).alias("n"), F.sum("strength").alias("weight")).where(
        (F.col("n") >= density * F.col("ts") * F.col("ts")) & (F.col("weight") > 0)
    )


def tile_positions(pix: DataFrame, rasters: DataFrame, ts: int, stride: int, threshold: float = 0.1, density: float = 0.01) -> DataFrame:
    """(raster_id, ty, tx, ts): the dense tiles of each raster (raster_id, h, w), or its middle tile if it has none."""
    dense = dense_tiles(pix, tile_grid(rasters, F.lit(ts), stride), threshold, density).select("raster_id", "ty", "tx", "ts")
    middle = rasters.select("raster_id", *[F.greatest(F.floor((F.col(n) - ts) / 2), F.lit(0)).cast("int").alias(c) for n, c in (("h", "ty"), ("w", "tx"))], F.lit(ts).alias("ts"))
    return dense.unionByName(middle.join(dense.select("raster_id").distinct(), "raster_id", "left_anti"))


def normalised_channels(colours: DataFrame, mean: list[float], deviation: list[float]) -> DataFrame:
    """(raster_id, y, x, r, g, b): channels of 0 to 255 as shares, less the mean, over the deviation of each."""
    return colours.select(*PIXEL, *[((F.col(c) / 255 - m) / s).alias(c) for c, m, s in zip("rgb", mean, deviation, strict=True)])


def cell_histogram(g: DataFrame, h: int, w: int, cells: int = 4, bins: int = 8) -> DataFrame:
    """(raster_id, cell, bin, value): magnitudes summed by direction of the gradient in a grid of cells; the rows and
    columns that are left over are ignored, and the last bin is closed."""
    ch, cw = h // cells, w // cells
    turn = F.round((F.atan2("gy", "gx") + F.pi()) / (2 * F.pi()), 9)
    place = F.least(F.floor(turn * bins), F.lit(bins - 1)).cast("int")
    inside = g.where((F.col("y") < ch * cells) & (F.col("x") < cw * cells))
    cell = (F.floor(F.col("y") / ch) * cells + F.floor(F.col("x") / cw)).cast("int")
    return inside.groupBy("raster_id", cell.alias("cell"), place.alias("bin")).agg(F.sum("mag").alias("value"))


def edge_descriptor(hist: DataFrame, cells: int = 4, bins: int = 8) -> DataFrame:
    """(raster_id, vec): the histogram's cells x bins values in order, at unit length."""
    by = hist.groupBy("raster_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("cell") * bins + F.col("bin")), "value"))).alias("m"))
    flat = F.transform(F.sequence(F.lit(0), F.lit(cells * cells * bins - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return by.select("raster_id", flat.alias("v")).select("raster_id", F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")).alias("vec"))


def lines_to_pixels(seg: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(drawing_id, y, x, and the columns ``keep``): distinct pixels of one-pixel lines between the truncated ends, a
    step a pixel along the longer axis."""
    x1, y1, x2, y2 = (F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2"))
    n = F.greatest(F.abs(x2 - x1), F.abs(y2 - y1))
    at = lambda a, b: F.floor(a + (b - a) * F.col("k") / F.greatest(n, F.lit(1)) + 0.5).cast("int")
    return seg.withColumn("k", F.explode(F.sequence(F.lit(0), n))).select("drawing_id", at(y1, y2).alias("y"), at(x1, x2).alias("x"), *(keep or [])).distinct()


def painted_rows(seg: DataFrame, together: int = drawings.MOST, sizes: DataFrame | None = None) -> DataFrame:
    """(drawing_id, y, n, sx, sxx): the pixels of lines_to_pixels() told by row: their number, and the sums of x and of its square. A
    drawing of up to ``together`` segments is one task; ``sizes`` as of drawings.larger()."""

    def told(d: drawings.Drawing) -> Iterator[pa.RecordBatch]:
        y, x = drawings.distinct_pixels(*drawings.painted(d)[1:])
        starts = np.flatnonzero(np.append(True, y[1:] != y[:-1])) if len(y) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(v, starts) if len(y) else v for v in (np.ones_like(x), x, x * x)]
        yield drawings.batch({"drawing_id": np.full(len(starts), d.id), "y": y[starts], "n": sums[0], "sx": sums[1], "sxx": sums[2]})

    small, large = drawings.whole(seg, told, "drawing_id bigint, y bigint, n bigint, sx bigint, sxx bigint", together), drawings.larger(seg, together, sizes)
    if large is None:
        return small
    x = F.col("x").cast("bigint")
    rows = lines_to_pixels(large).groupBy("drawing_id", F.col("y").cast("bigint").alias("y"))
    return small.unionByName(rows.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx")))


def components(pix: DataFrame, h: int, w: int, side: int = BLOCK) -> DataFrame:
    """Adds ``label``: the least y * w + x of the pixel's 8-connected component.

    A block of a raster is labelled in one task, by links of touching pixels to the lower of their labels, which are then
    followed to their ends. Labels that touch across the sides of blocks are links of a graph, whose classes give the least.
    """
    block = block_of(F.col("y"), F.col("x"), w, side).alias("_block")
    schema = T.StructType([*pix.schema.fields, T.StructField("label", T.LongType())])

    def label(pdf):
        ys, xs = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        known, own = np.unique(ys * (w + 2) + xs, return_inverse=True)  # two columns more, so that rows do not touch
        touching = []
        for step in (1, w + 1, w + 2, w + 3):
            at = np.searchsorted(known, known + step)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == known + step)
            touching.append(np.stack([hit, at[hit]]))
        a, b = np.concatenate(touching, axis=1)
        least = np.arange(len(known))
        while not (least[a] == least[b]).all():
            np.minimum.at(least, np.maximum(least[a], least[b]), np.minimum(least[a], least[b]))
            while not (least[least] == least).all():
                least = least[least]
        first = known[least[own]]
        return pdf.assign(label=first // (w + 2) * w + first % (w + 2))

    labelled = pix.select("*", block).groupBy("raster_id", "_block").applyInPandas(lambda pdf: label(pdf.drop(columns="_block")), schema)
    if h <= side and w <= side:
        return labelled
    labelled = written(labelled, "components")
    rim = [F.pmod(F.col(c), F.lit(side)).isin(0, side - 1) for c in "yx"]
    ends = labelled.where(rim[0] | rim[1]).select(*PIXEL, "label").distinct()
    beyond = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in NEIGHBOURS])
    asked = ends.select("raster_id", block, F.col("label").alias("a"), F.explode(beyond).alias("t")).where(block_of(F.col("t.y"), F.col("t.x"), w, side) != F.col("_block"))
    touching = asked.select("raster_id", "t.y", "t.x", "a").join(ends, PIXEL).select("raster_id", "a", F.col("label").alias("b"))
    ends = roots(touching, ["raster_id"]).withColumnRenamed("node", "label")
    return labelled.join(ends, ["raster_id", "label"], "left").withColumn("label", F.coalesce("root", "label")).select(*schema.names)


def large_components(pix: DataFrame, h: int, w: int, least: int = 30, side: int = BLOCK) -> DataFrame:
    """Pixels of components of at least ``least`` pixels."""
    labelled = components(pix, h, w, side)
    if h <= side and w <= side:  # a component is in one block, and is not labelled twice
        return labelled.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("raster_id", "label"))).where(F.col("n") >= least).drop("label", "n")
    big = labelled.groupBy("raster_id", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return labelled.join(big, ["raster_id", "label"], "left_semi").drop("label")


def saliency(colours: DataFrame, h: int, w: int) -> DataFrame:
    """Adds ``mask`` (255 or 0) to (raster_id, y, x, r, g, b): half a centre prior and half the distance from the mean
    colour, above their 60th percentile."""
    by = W.partitionBy("raster_id")
    sigma = min(h, w) / 3
    prior = F.exp(-((F.col("x") - w / 2) ** 2 + (F.col("y") - h / 2) ** 2) / (2 * sigma * sigma))
    away = F.sqrt(sum(((F.col(c) - F.avg(c).over(by)) ** 2 for c in "rgb"), F.lit(0.0)))
    valued = colours.withColumn("away", away).withColumn("s", F.round(0.5 * prior + 0.5 * F.when(F.max("away").over(by) > 0, F.col("away") / F.max("away").over(by)).otherwise(0.0), 9))
    cut = valued.groupBy("raster_id").agg(F.percentile("s", 0.6).alias("cut"))
    return valued.join(cut, "raster_id").withColumn("mask", F.when(F.col("s") > F.round("cut", 9), 255).otherwise(0)).drop("away", "s", "cut")


def figure_mask(colours: DataFrame, threshold: float = 128) -> DataFrame:
    """(raster_id, y, x, r, g, b, mask): 255 where the mean of the channels is over ``threshold``, else 0."""
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    return colours.withColumn("mask", F.when(mean > threshold, 255).otherwise(0))


def figure_ground(masked: DataFrame) -> DataFrame:
    """(raster_id, y, x, and for figure_, ground_ and overlay_ the channels r, g, b and a) of figure_mask()'s rows.

    The figure is opaque where the mask is set, the ground where it is not; the overlay has the figure half way to
    white. Elsewhere all four are 0.
    """
    fig = F.col("mask") > 0
    zero = F.lit(0.0)

    def layer(name: str, on: Column) -> list[Column]:
        return [*[F.when(on, F.col(c)).otherwise(zero).alias(f"{name}_{c}") for c in "rgb"], F.when(on, 255.0).otherwise(zero).alias(f"{name}_a")]

    over = [F.when(fig, F.floor(0.5 * F.col(c) + 127.5).cast("double")).otherwise(F.col(c)).alias(f"overlay_{c}") for c in "rgb"]
    return masked.select(*PIXEL, *layer("figure", fig), *layer("ground", ~fig), *over, F.lit(255.0).alias("overlay_a"))
