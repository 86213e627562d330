"""Splitting drawings: by ranked properties, by scores, at junctions; merging and duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeframe.tables import written

from .geometry import CONTOUR, SEGMENT, with_length


def criteria(seg: DataFrame) -> DataFrame:
    """(drawing_id, contour_id, length, curvature, orientation): what contours are ranked by; needs len, ori, curv."""
    hv = F.abs(F.cos(F.radians("ori"))) - F.abs(F.sin(F.radians("ori")))
    return seg.groupBy(*CONTOUR).agg(
        F.sum("len").alias("length"), F.sum(F.col("curv") * F.col("len")).alias("curvature"), F.sum(hv * F.col("len")).alias("orientation")
    )


#: Segments whose contours are merged in one task, about.
TOGETHER = 4096


def cumulative_split(contours: DataFrame, score: Column, fraction: float = 0.5) -> DataFrame:
    """Adds ``bottom`` and ``top``: whether the contour is in the first ``fraction`` of the drawing's length in the
    order of ``score``, and in the last. ``length`` is the contour's; ties go by contour_id."""
    ranked = contours.withColumn("_score", score)
    run = W.partitionBy("drawing_id").orderBy("_score", "contour_id").rowsBetween(W.unboundedPreceding, 0)
    share = F.round(F.sum("length").over(run) / F.sum("length").over(W.partitionBy("drawing_id")), 9)
    return ranked.withColumn("share", share).withColumns({"bottom": F.col("share") <= fraction, "top": F.col("share") >= 1 - fraction}).drop("_score")


def split_by_properties(contours: DataFrame, weights: dict[str, float], fraction: float = 0.5) -> DataFrame:
    """Contours ranked by each property from 1 up, the weighted ranks added, then split."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * F.row_number().over(W.partitionBy("drawing_id").orderBy(F.round(name, 9), "contour_id"))
    return contours.withColumn("rank", total).transform(lambda d: cumulative_split(d, F.col("rank"), fraction))


def histogram_score(hist: DataFrame, weights: list[float]) -> DataFrame:
    """(drawing_id, contour_id, score): the weighted sum of a contour's normalised bins."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("bin") + 1)
    return hist.where("contour_id IS NOT NULL").groupBy(*CONTOUR).agg(F.sum(F.col("norm_value") * weight).alias("score"))


def split_at_junctions(seg: DataFrame, junctions: DataFrame) -> DataFrame:
    """(drawing_id, contour_id, piece, seg_id, x1, y1, x2, y2): contours cut where they have junctions (drawing_id,
    contour_id, seg_id, x, y), in order of the distance from the segment's start."""
    d = F.sqrt((F.col("x") - F.col("x1")) ** 2 + (F.col("y") - F.col("y1")) ** 2)
    cuts = seg.join(junctions.select(*SEGMENT, "x", "y").distinct(), SEGMENT).groupBy(*SEGMENT).agg(
        F.array_sort(F.collect_list(F.struct(d.alias("d"), F.col("x"), F.col("y")))).alias("cuts")
    )
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    inner = F.coalesce(F.transform("cuts", lambda c: point(c["x"], c["y"])), F.array().cast("array<struct<x:double,y:double>>"))
    path = F.concat(F.array(point(F.col("x1"), F.col("y1"))), inner, F.array(point(F.col("x2"), F.col("y2"))))
    cut = seg.join(cuts, SEGMENT, "left").withColumn("path", path).select(*SEGMENT, "path", F.posexplode(F.slice("path", 2, 1 << 30)).alias("k", "to"))
    cut = cut.withColumn("frm", F.get("path", F.col("k"))).where("frm.x <> to.x OR frm.y <> to.y")
    w = W.partitionBy(*CONTOUR).orderBy("seg_id", "k").rowsBetween(W.unboundedPreceding, 0)
    return cut.withColumn("piece", F.sum((F.col("k") > 0).cast("int")).over(w)).select(
        *CONTOUR, "piece", "seg_id", F.col("frm.x").alias("x1"), F.col("frm.y").alias("y1"), F.col("to.x").alias("x2"), F.col("to.y").alias("y2")
    )


def duplicate_contours(seg: DataFrame, within: float = 1.0, cell: float = 16.0) -> DataFrame:
    """(drawing_id, contour_id) of contours to drop: another of the drawing lies within ``within`` of it, vertex set
    to vertex set and back, and is longer (or as long with a lesser id).

    Candidates share a cell of the grid that the padded first vertices touch, as the first vertex of one must
    be near some vertex of the other.
    """
    ends = F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    verts = seg.select(*CONTOUR, ends.alias("p")).select(*CONTOUR, "p.*").distinct()
    lengths = with_length(seg).groupBy(*CONTOUR).agg(F.sum("len").alias("clen"), F.min_by(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), "seg_id").alias("f"))
    step = F.array(*[F.lit(k).cast("bigint") for k in (-1, 0, 1)])
    grid = verts.select("drawing_id", F.col("contour_id").alias("b"), F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")).distinct()
    first = lengths.select("drawing_id", F.col("contour_id").alias("a"), F.explode(F.transform(step, lambda k: F.floor(F.col("f.x") / cell) + k)).alias("gx"), "f")
    first = first.withColumn("gy", F.explode(F.transform(step, lambda k: F.floor(F.col("f.y") / cell) + k))).drop("f")
    pairs = first.join(grid, ["drawing_id", "gx", "gy"]).where("a <> b").select("drawing_id", "a", "b").distinct()
    va = verts.select("drawing_id", F.col("contour_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    vb = verts.select("drawing_id", F.col("contour_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    nearest = pairs.join(va, ["drawing_id", "a"]).join(vb, ["drawing_id", "b"]).groupBy("drawing_id", "a", "b", "ax", "ay").agg(F.min(d).alias("d"))
    close = nearest.groupBy("drawing_id", "a", "b").agg(F.max("d").alias("d")).where(F.col("d") < within)
    back = close.select("drawing_id", F.col("a").alias("b"), F.col("b").alias("a"))
    both = close.join(back, ["drawing_id", "a", "b"], "left_semi")
    la = lengths.select("drawing_id", F.col("contour_id").alias("a"), F.col("clen").alias("la"))
    lb = lengths.select("drawing_id", F.col("contour_id").alias("b"), F.col("clen").alias("lb"))
    worse = (F.round("la", 9) < F.round("lb", 9)) | ((F.round("la", 9) == F.round("lb", 9)) & (F.col("a") > F.col("b")))
    return both.join(la, ["drawing_id", "a"]).join(lb, ["drawing_id", "b"]).where(worse).select("drawing_id", F.col("a").alias("contour_id")).distinct()


def merge_straight_runs(seg: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(drawing_id, contour_id, seg_id, x1, y1, x2, y2): from each segment on, the longest run whose inner points
    lie within ``threshold`` of its chord on average becomes one segment. Contours are dealt to tasks of about TOGETHER segments."""

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for contour, own in pdf.sort_values(["contour_id", "seg_id"]).groupby("contour_id"):
            p = np.concatenate([own[["x1", "y1"]].to_numpy(), own[["x2", "y2"]].to_numpy()[-1:]])
            i, n = 0, 0
            while i < len(p) - 1:
                best = i + 1
                for j in range(i + 2, len(p)):
                    chord, rel = p[j] - p[i], p[i + 1 : j] - p[i]
                    length = np.hypot(*chord)
                    away = np.abs(chord[0] * rel[:, 1] - chord[1] * rel[:, 0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
                    if away.mean() > threshold:
                        break
                    best = j
                out.append((pdf["drawing_id"].iloc[0], contour, n, *p[i], *p[best]))
                i, n = best, n + 1
        return pd.DataFrame(out, columns=[*SEGMENT, "x1", "y1", "x2", "y2"])

    schema = "drawing_id bigint, contour_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double"
    tasks = seg.groupBy("drawing_id").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("tasks"))
    return seg.select(*SEGMENT, "x1", "y1", "x2", "y2").join(tasks, "drawing_id").withColumn(
        "task", F.pmod(F.xxhash64("contour_id"), F.col("tasks"))
    ).groupBy("drawing_id", "task").applyInPandas(runs, schema)



def merge_lines(seg: DataFrame, threshold: float = 1.0, within: float = 1.0) -> DataFrame:
    """(drawing_id, contour_id, seg_id, x1, y1, x2, y2): straight runs merged, then contours that lie on others dropped."""
    merged = written(merge_straight_runs(seg, threshold), "merged-lines")
    return merged.join(duplicate_contours(merged, within), CONTOUR, "left_anti").select(*merged.columns)
