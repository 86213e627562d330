"""Geometry of segments and contours: Column expressions and windows.

A segment table has (drawing_id, contour_id, seg_id, x1, y1, x2, y2); seg_id orders the segments of a contour.
y grows downward. All functions return new DataFrames; added columns are named in their docstrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CONTOUR = ["drawing_id", "contour_id"]
SEGMENT = [*CONTOUR, "seg_id"]


def along(*extra: str) -> W:
    """The window of a contour in the order of its segments."""
    return W.partitionBy(*CONTOUR, *extra).orderBy("seg_id")


def with_length(seg: DataFrame) -> DataFrame:
    """Adds ``len``, the segment's length."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return seg.withColumn("len", F.sqrt(dx * dx + dy * dy))


def with_orientation(seg: DataFrame) -> DataFrame:
    """Adds ``ori`` in [0, 360) degrees, of the coordinates truncated to integers, with y pointing up."""
    x1, y1, x2, y2 = (F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2"))
    return seg.withColumn("ori", F.pmod(F.degrees(F.atan2((y1 - y2).cast("double"), (x2 - x1).cast("double"))), F.lit(360.0)))


def with_curvature(seg: DataFrame) -> DataFrame:
    """Adds ``curv``: the turn to the next segment (for the last, to the one before) over the length; alone, 0."""
    turn = F.abs(F.col("ori") - F.coalesce(F.lead("ori").over(along()), F.lag("ori").over(along())))
    turn = F.when(turn > 180, 360 - turn).otherwise(turn)
    return seg.withColumn("curv", F.coalesce(turn / (F.col("len") + 1e-10), F.lit(0.0)))


def with_properties(seg: DataFrame, which: list[str] | None = None) -> DataFrame:
    """Adds the named properties (any case): length, orientation, curvature; all if None. ValueError for others."""
    names = [w.lower() for w in which or ["length", "orientation", "curvature"]]
    known = {"length": [with_length], "orientation": [with_orientation], "curvature": [with_length, with_orientation, with_curvature]}
    for name in names:
        if name not in known:
            raise ValueError(f"unknown property {name}")
        for step in known[name]:
            seg = seg.transform(step)
    return seg


def contour_lengths(seg: DataFrame) -> DataFrame:
    """(drawing_id, contour_id, clen): the sum of a contour's segment lengths."""
    return with_length(seg).groupBy(*CONTOUR).agg(F.sum("len").alias("clen"))


def rotate(seg: DataFrame, angle: float, width: float, height: float) -> DataFrame:
    """Every point turned by ``angle`` degrees about the canvas centre; sine and cosine have five decimals."""
    from math import cos, radians, sin

    c, s = round(cos(radians(angle)), 5), round(sin(radians(angle)), 5)
    cx, cy = width / 2, height / 2

    def point(x: str, y: str) -> tuple[Column, Column]:
        dx, dy = F.col(x) - cx, F.col(y) - cy
        return dx * c - dy * s + cx, dx * s + dy * c + cy

    (x1, y1), (x2, y2) = point("x1", "y1"), point("x2", "y2")
    return seg.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


def clip_to_circle(seg: DataFrame, width: float, height: float, radius: float | None = None) -> DataFrame:
    """(drawing_id, contour_id, piece, seg_id, x1, y1, x2, y2): what lies in the circle about the canvas centre.

    A point at the radius is inside. A segment with both ends outside is dropped, even if it crosses the
    circle; one that leaves ends its piece; one that enters is a piece of its own.
    """
    r = min(width, height) / 2 if radius is None else radius
    cx, cy = width / 2, height / 2
    px, py = F.col("x1") - cx, F.col("y1") - cy
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def inside(x: str, y: str) -> Column:
        return F.sqrt((F.col(x) - cx) * (F.col(x) - cx) + (F.col(y) - cy) * (F.col(y) - cy)) <= r

    a, b, c = dx * dx + dy * dy, 2 * (px * dx + py * dy), px * px + py * py - r * r
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    leave, enter = (-b + root) / (2 * a), (-b - root) / (2 * a)
    marked = seg.withColumns({"in1": inside("x1", "y1"), "in2": inside("x2", "y2")}).where("in1 OR in2")
    t = F.when(F.col("in1"), leave).otherwise(enter)
    cut_x, cut_y = F.col("x1") + t * dx, F.col("y1") + t * dy
    both = F.col("in1") & F.col("in2")
    # a new piece begins where the segment before it is missing, has left, or has entered
    w = along()
    before = F.lag(both).over(w) & (F.lag("seg_id").over(w) == F.col("seg_id") - 1)
    fresh = (~F.coalesce(before, F.lit(False))) | ~F.col("in1")
    piece = F.sum(fresh.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    clipped = marked.withColumn("piece", piece)
    return clipped.select(
        *CONTOUR, "piece", "seg_id",
        F.when(F.col("in1"), F.col("x1")).otherwise(cut_x).alias("x1"), F.when(F.col("in1"), F.col("y1")).otherwise(cut_y).alias("y1"),
        F.when(F.col("in2"), F.col("x2")).otherwise(cut_x).alias("x2"), F.when(F.col("in2"), F.col("y2")).otherwise(cut_y).alias("y2"),
    )


def shift_contours(seg: DataFrame, width: float, height: float, most: int, seed: int = 0) -> DataFrame:
    """Every contour moved by its own uniform integer shift of at most ``most``, so that it stays on the canvas."""
    box = seg.groupBy(*CONTOUR).agg(
        *[f(F.least(a, b) if f is F.min else F.greatest(a, b)).alias(n) for n, f, a, b in (("l", F.min, "x1", "x2"), ("r", F.max, "x1", "x2"), ("t", F.min, "y1", "y2"), ("b", F.max, "y1", "y2"))]
    )

    def draw(low: Column, high: Column, salt: int) -> Column:
        # from a hash of the contour, so that a recomputed task draws the same
        share = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *CONTOUR), F.lit(1 << 20)) / float(1 << 20)
        low, high = F.ceil(F.greatest(low, F.lit(-most))), F.floor(F.least(high, F.lit(most)))
        return F.when(high >= low, low + F.floor(share * (high - low + 1))).otherwise(F.lit(0)).cast("double")

    moved = box.select(*CONTOUR, draw(-F.col("l"), width - F.col("r"), 1).alias("sx"), draw(-F.col("t"), height - F.col("b"), 2).alias("sy"))
    joined = seg.join(moved, CONTOUR)
    return joined.withColumns({"x1": F.col("x1") + F.col("sx"), "x2": F.col("x2") + F.col("sx"), "y1": F.col("y1") + F.col("sy"), "y2": F.col("y2") + F.col("sy")}).drop("sx", "sy")


def chord_distance(seg: DataFrame) -> DataFrame:
    """(drawing_id, contour_id, dist): mean distance of a contour's inner points from its chord; 0 without inner points."""
    ends = seg.groupBy(*CONTOUR).agg(F.min_by(F.struct("x1", "y1"), "seg_id").alias("a"), F.max_by(F.struct("x2", "y2"), "seg_id").alias("b"), F.max("seg_id").alias("last"))
    j = seg.join(ends, CONTOUR).where("seg_id < last")
    ax, ay, bx, by = F.col("a.x1"), F.col("a.y1"), F.col("b.x2"), F.col("b.y2")
    chord = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    away = F.sqrt((F.col("x2") - ax) * (F.col("x2") - ax) + (F.col("y2") - ay) * (F.col("y2") - ay))
    line = F.abs((bx - ax) * (ay - F.col("y2")) - (ax - F.col("x2")) * (by - ay)) / chord
    means = j.groupBy(*CONTOUR).agg(F.avg(F.when(chord > 0, line).otherwise(away)).alias("dist"))
    return ends.select(*CONTOUR).join(means, CONTOUR, "left").select(*CONTOUR, F.coalesce("dist", F.lit(0.0)).alias("dist"))


def color_index(df: DataFrame, value: Column, over: list[str], cap: float = 1.0) -> DataFrame:
    """Adds ``color``: ``value`` scaled from the minimum and ``cap`` times the maximum of its group to 1..256, rounded half to even."""
    w = W.partitionBy(*over)
    low, high = F.min(value).over(w), F.max(value).over(w) * cap
    scaled = F.when(high > low, (value - low) / (high - low) * 255 + 1).otherwise(F.lit(1.0))
    return df.withColumn("color", F.least(F.bround(scaled), F.lit(256.0)))


def orientation_color(seg: DataFrame) -> DataFrame:
    """Adds ``color``: orientation modulo 180 on 1..256."""
    return seg.withColumn("color", F.bround(F.pmod("ori", F.lit(180.0)) / 180 * 255 + 1))


def drop_zero_length(seg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments of contours with a length, (drawing_id, contour_id) of those without)."""
    lengths = contour_lengths(seg)
    gone = lengths.where("clen = 0").select(*CONTOUR)
    return seg.join(gone, CONTOUR, "left_anti"), gone


def keep_long_contours(seg: DataFrame, percentile: float) -> DataFrame:
    """Contours at least as long as the drawing's ``percentile`` (0 to 100, interpolated) of contour lengths."""
    lengths = contour_lengths(seg)
    cut = lengths.groupBy("drawing_id").agg(F.percentile("clen", percentile / 100).alias("cut"))
    kept = lengths.join(cut, "drawing_id").where("clen >= cut").select(*CONTOUR)
    return seg.join(kept, CONTOUR, "left_semi")


def points_in_tile(seg: DataFrame, y: int, x: int, size: int) -> DataFrame:
    """(drawing_id, contour_id, seg_id, px, py): endpoints in the half-open square, each on its own."""
    ends = F.explode(F.array(F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.col("x2").alias("px"), F.col("y2").alias("py"))))
    return seg.select(*SEGMENT, ends.alias("p")).select(*SEGMENT, "p.*").where((F.col("px") >= x) & (F.col("px") < x + size) & (F.col("py") >= y) & (F.col("py") < y + size))


def arc_length(seg: DataFrame) -> DataFrame:
    """Adds ``s1`` and ``s2``, the arc length at the segment's ends, and ``total``; needs ``len``."""
    w = along()
    return seg.withColumns({"s2": F.sum("len").over(w.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("len").over(W.partitionBy(*CONTOUR))}).withColumn("s1", F.col("s2") - F.col("len"))


def middle_and_ends(seg: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(drawing_id, contour_id, seg_id, part, x1, y1, x2, y2): segments cut at ``low`` and ``high`` of the arc
    length; part is head, middle or tail. Pieces of no length are dropped."""
    s = arc_length(with_length(seg))
    cuts = [F.lit(0.0), F.col("total") * low, F.col("total") * high, F.col("total")]

    def piece(k: int, name: str) -> Column:
        a, b = F.greatest(F.col("s1"), cuts[k]), F.least(F.col("s2"), cuts[k + 1])
        return F.when(b > a, F.struct(F.lit(name).alias("part"), ((a - F.col("s1")) / F.col("len")).alias("ta"), ((b - F.col("s1")) / F.col("len")).alias("tb")))

    parts = F.explode(F.array_compact(F.array(*[piece(k, n) for k, n in enumerate(("head", "middle", "tail"))])))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return s.withColumn("p", parts).select(
        *SEGMENT, "p.part", (F.col("x1") + F.col("p.ta") * dx).alias("x1"), (F.col("y1") + F.col("p.ta") * dy).alias("y1"),
        (F.col("x1") + F.col("p.tb") * dx).alias("x2"), (F.col("y1") + F.col("p.tb") * dy).alias("y2"),
    )
