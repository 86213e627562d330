"""Length-weighted histograms, averages and feature tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import drawings
from .geometry import CONTOUR, contour_lengths, with_length
from .raster import lines_to_pixels

#: Lines of a map that are smoothed together.
STRIP = 64


def weighted_histogram(seg: DataFrame, bin_: Column, weight: Column, lengths: DataFrame) -> DataFrame:
    """(drawing_id, contour_id, bin, value, norm_value): ``weight`` summed by contour and bin; norm_value is per
    10000 of the contour's length. contour_id null: the sums over the drawing, in the same pass."""
    binned = seg.withColumn("bin", bin_).groupBy(*CONTOUR, "bin").agg(F.sum(weight).alias("value"))
    normed = binned.join(lengths, CONTOUR).withColumn("norm_value", F.when(F.col("clen") > 0, F.col("value") / F.col("clen") * 10000).otherwise(F.lit(0.0)))
    return normed.groupingSets([[F.col(c) for c in (*CONTOUR, "bin")], [F.col("drawing_id"), F.col("bin")]], *[F.col(c) for c in (*CONTOUR, "bin")]).agg(
        F.sum("value").alias("value"), F.sum("norm_value").alias("norm_value")
    )


def orientation_bin(bins: int = 8) -> Column:
    """Bins of 180 / ``bins`` degrees, the first centred at 0."""
    w = 180 / bins
    shifted = F.pmod(F.col("ori") + w / 2, F.lit(180.0))
    return F.least(F.floor(shifted / w), F.lit(bins - 1)).cast("int")


def log_bin(value: Column, low: float, high: float, bins: int = 8) -> Column:
    """Equal bins of log10(value + 1) between those of ``low`` and ``high``; outside, the first and the last."""
    from math import log10

    a, b = log10(low + 1), log10(high + 1)
    place = F.floor(F.round((F.log10(value + 1) - a) / ((b - a) / bins), 9))
    return F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")


def horizontal_vertical(bins: int = 8) -> Column:
    """Bin of abs(cos) - abs(sin) of the orientation on [-1, 1]."""
    hv = F.round(F.abs(F.cos(F.radians("ori"))) - F.abs(F.sin(F.radians("ori"))), 9)
    return F.greatest(F.least(F.floor((hv + 1) / (2 / bins)), F.lit(bins - 1)), F.lit(0)).cast("int")


def orientation_stats(seg: DataFrame, bins: int = 8) -> DataFrame:
    return weighted_histogram(seg, orientation_bin(bins), F.col("len"), contour_lengths(seg))


def curvature_stats(seg: DataFrame, bins: int = 8, low: float = 0, high: float = 90) -> DataFrame:
    return weighted_histogram(seg, log_bin(F.col("curv"), low, high, bins), F.col("len"), contour_lengths(seg))


def horizontal_vertical_stats(seg: DataFrame, bins: int = 8) -> DataFrame:
    return weighted_histogram(seg, horizontal_vertical(bins), F.col("len"), contour_lengths(seg))


def length_stats(seg: DataFrame, width: float, height: float, bins: int = 8) -> DataFrame:
    """The whole contour's length goes into one bin between log10 of 2 and of width + height."""
    lengths = contour_lengths(seg)
    return weighted_histogram(lengths, log_bin(F.col("clen"), 2, width + height, bins), F.col("clen"), lengths)


def score_stats(scores: DataFrame, value: str, bins: int = 8) -> DataFrame:
    """(drawing_id, bin, n): equal bins on [0, 1], the last closed; null and NaN are ignored."""
    good = scores.where(F.col(value).isNotNull() & ~F.isnan(value))
    return good.groupBy("drawing_id", F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def average_orientation(seg: DataFrame) -> DataFrame:
    """(drawing_id, avg_ori): direction of the sum of the segments, those beyond 180 degrees reversed, modulo 180."""
    sign = F.when(F.col("ori") > 180, -1.0).otherwise(1.0)
    sx, sy = F.sum(sign * (F.col("x2") - F.col("x1"))), F.sum(sign * (F.col("y2") - F.col("y1")))
    return seg.groupBy("drawing_id").agg(F.pmod(F.degrees(F.atan2(-sy, sx)), F.lit(180.0)).alias("avg_ori"))


def average_length(seg: DataFrame) -> DataFrame:
    return contour_lengths(seg).groupBy("drawing_id").agg(F.avg("clen").alias("avg_len"))


def average_curvature(seg: DataFrame) -> DataFrame:
    """The mean weighted by length."""
    return seg.groupBy("drawing_id").agg((F.sum(F.col("curv") * F.col("len")) / F.sum("len")).alias("avg_curv"))


def wide_table(hist: DataFrame, short: str, bins: list, value: str = "norm_value") -> DataFrame:
    """One row a drawing with a column ``{short}_{bin}`` for each bin (integers count from 1); absent bins are 0."""
    sums = hist.where("contour_id IS NULL") if "contour_id" in hist.columns else hist
    wide = sums.groupBy("drawing_id").pivot("bin", bins).agg(F.sum(value))
    name = lambda b: f"{short}_{b + 1}" if isinstance(b, int) else f"{short}_{b}"
    return wide.select("drawing_id", *[F.coalesce(F.col(f"`{b}`"), F.lit(0.0)).alias(name(b)) for b in bins])


def scene_table(scenes: DataFrame, histograms: dict[str, tuple[DataFrame, list]], value: str = "norm_value") -> DataFrame:
    """``scenes`` (drawing_id, ...) with the wide_table() of each of ``histograms`` (by short name, with its bins); a
    scene that is in none of a histogram has 0."""
    for short, (hist, bins) in histograms.items():
        wide = wide_table(hist, short, bins, value)
        scenes = scenes.join(wide, "drawing_id", "left").fillna(0.0, [c for c in wide.columns if c != "drawing_id"])
    return scenes


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values, or tuples, with their counts."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def linear_scores(hist: DataFrame, coefficients: list[float], intercept: float = 0.0) -> DataFrame:
    """(drawing_id, contour_id, score): a linear model of each contour's normalised histogram."""
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in coefficients]), F.col("bin") + 1)
    return hist.where("contour_id IS NOT NULL").groupBy(*CONTOUR).agg((F.sum(F.col("norm_value") * weight) + intercept).alias("score"))


def strength_summary(pix: DataFrame, h: int, w: int) -> DataFrame:
    """(raster_id, share, top, mean): share of pixels above 0, the largest strength, and the mean of those above 0."""
    on = pix.where("strength > 0").groupBy("raster_id")
    return on.agg((F.count(F.lit(1)) / float(h * w)).alias("share"), F.max("strength").alias("top"), F.avg("strength").alias("mean"))


def property_ranges(seg: DataFrame, columns: list[str]) -> DataFrame:
    """(property, low, high) over all segments; NaN and null are ignored."""
    sane = seg.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("property", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    return sane.groupBy("property").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def density(pixels: DataFrame, value: str, order: str) -> DataFrame:
    """(drawing_id, y, x, value): of all that is painted on a pixel, what comes last in ``order``."""
    return pixels.groupBy("drawing_id", "y", "x").agg(F.max_by(value, order).alias("value"))


def density_rows(seg: DataFrame, together: int = drawings.MOST, sizes: DataFrame | None = None) -> DataFrame:
    """(drawing_id, y, n, value, moment): the map of the length of the segment painted last on each pixel, in the order of contours and
    segments, told by row: the number of pixels, the sum, and the sum by x. A drawing of up to ``together`` segments is one task;
    ``sizes`` as of drawings.larger()."""

    def told(d: drawings.Drawing) -> Iterator[pa.RecordBatch]:
        own, y, x = drawings.painted(d)
        y, x, at = drawings.last_painted(y, x)
        value = d.len[own[at]]
        starts = np.flatnonzero(np.append(True, y[1:] != y[:-1])) if len(y) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(v, starts) if len(y) else v for v in (np.ones_like(x), value, value * x)]
        yield drawings.batch({"drawing_id": np.full(len(starts), d.id), "y": y[starts].astype(np.int32), "n": sums[0], "value": sums[1], "moment": sums[2]})

    small, large = drawings.whole(seg, told, "drawing_id bigint, y int, n bigint, value double, moment double", together), drawings.larger(seg, together, sizes)
    if large is not None:
        ordered = with_length(large).withColumn("o", F.struct("contour_id", "seg_id"))
        rows = density(lines_to_pixels(ordered, ["o", "len"]), "len", "o").groupBy("drawing_id", "y")
        small = small.unionByName(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.sum(F.col("value") * F.col("x")).alias("moment")))
    return small.select("drawing_id", "y", "n", F.round("value", 2).alias("value"), F.round("moment", 0).alias("moment"))


def gaussian(sigma: float) -> list[float]:
    """The weights of a smoothing kernel for floats, four deviations on either side; they add up to 1."""
    n = int(8 * sigma + 1 + 0.5) | 1
    raw = [math.exp(-((k - n // 2) ** 2) / (2 * sigma * sigma)) for k in range(n)]
    return [x / sum(raw) for x in raw]


def _mirrored(q: np.ndarray, n: int) -> np.ndarray:
    """The places 0 to n - 1 that stand for places beyond the sides, mirrored about the outermost ones."""
    turn = q % max(2 * n - 2, 1)
    return np.where(turn < n, turn, 2 * n - 2 - turn)


def blurred(painted: DataFrame, columns: list[str], sigma: float, h: int, w: int) -> DataFrame:
    """(drawing_id, y, x, *columns): the maps ``columns`` (0 where no pixel is painted) smoothed by a Gaussian of ``sigma`` pixels,
    mirrored at the sides about the outermost pixel; places out of reach have no row. ``sigma`` 0 gives the maps as they are.

    The kernel is separable: strips of STRIP columns are smoothed downwards, then strips of rows across, a shuffle for each. A
    task holds one strip.
    """
    out = painted.select("drawing_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), *[F.col(c).cast("double").alias(c) for c in columns])
    if sigma <= 0:
        return out
    for along, across, n in (("y", "x", h), ("x", "y", w)):
        strips = out.withColumn("_strip", F.floor(F.col(across) / STRIP)).groupBy("drawing_id", "_strip")
        out = strips.applyInArrow(_smooth(along, across, n, columns, gaussian(sigma)), out.schema)
    return out


def _smooth(along: str, across: str, n: int, columns: list[str], weights: list[float]) -> Callable[[pa.Table], pa.Table]:
    taken = [_mirrored(np.arange(n) + k, n) for k in range(-(len(weights) // 2), len(weights) // 2 + 1)]

    def smooth(table: pa.Table) -> pa.Table:
        p, q = table.column(along).to_numpy(), table.column(across).to_numpy()
        first = q.min()
        there = np.zeros((n, q.max() - first + 1), bool)
        there[p, q - first] = True
        at, beside = np.nonzero(np.logical_or.reduce([there[t] for t in taken]))
        made = {"drawing_id": pa.array(np.full(len(at), table.column("drawing_id")[0].as_py())), along: pa.array(at), across: pa.array(beside + first)}
        for c in columns:
            dense = np.zeros(there.shape)
            dense[p, q - first] = table.column(c).to_numpy()
            made[c] = pa.array(sum(g * dense[t] for g, t in zip(weights, taken, strict=True))[at, beside])
        return pa.table({c: made[c] for c in ("drawing_id", "y", "x", *columns)})

    return smooth


def orientation_density(pixels: DataFrame, degrees: str, order: str, sigma: float, h: int, w: int) -> DataFrame:
    """(drawing_id, y, x, value): the orientation painted last on each pixel, as atan2(cos, sin) in degrees of the angle
    modulo 180, its sine and cosine smoothed apart."""
    angle = F.radians(F.pmod(F.col(degrees), F.lit(180.0)))
    last = pixels.groupBy("drawing_id", "y", "x").agg(F.max_by(F.struct(F.sin(angle).alias("s"), F.cos(angle).alias("c")), order).alias("v"))
    maps = blurred(last.select("drawing_id", "y", "x", "v.s", "v.c"), ["s", "c"], sigma, h, w)
    return maps.select("drawing_id", "y", "x", F.degrees(F.atan2("c", "s")).alias("value"))


def normalised_scores(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``level``: the score between the least (0) and the greatest (1) of its drawing, 0 where all are equal."""
    w = W.partitionBy("drawing_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scores.withColumn("level", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.0))


def contour_stats(seg: DataFrame, width: int, height: int, which: list[str]) -> DataFrame:
    """(property, drawing_id, contour_id, bin, value, norm_value): the histograms named in ``which`` (orientation,
    curvature, horver, length; in any case of letters) one after the other. ValueError for another name."""
    made = {
        "orientation": orientation_stats, "curvature": curvature_stats, "horver": horizontal_vertical_stats,
        "length": lambda s: length_stats(s, width, height),
    }
    names = [n.lower() for n in which]
    if not names or set(names) - set(made):
        raise ValueError(f"no such statistics: {sorted(set(names) - set(made))}")
    parts = [made[n](seg).withColumn("property", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, parts)
