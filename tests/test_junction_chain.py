"""Merged junctions, a drawing at once and in parts, and what is worked out from them; links and smoothing against plain versions."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeframe.operators import geometry, junctions, medial, scan, split, stats
from strokeframe.operators.links import roots

SEG = "drawing_id bigint, contour_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double"


def drawings(spark):
    """Random strokes, many of which cross near one another; and a cross with four arms."""
    rng = np.random.default_rng(3)
    rows = []
    for d in range(2):
        for c in range(40):
            p = rng.integers(0, 60, (4, 2))
            rows += [(d, c, s, *map(float, (*p[s], *p[s + 1]))) for s in range(3)]
    rows += [(9, 1, 0, 0.0, 50.0, 100.0, 50.0), (9, 2, 0, 50.0, 0.0, 50.0, 100.0)]
    return spark.createDataFrame(rows, SEG)


def plain_classes(found, within=2.0):
    order = sorted(found, key=lambda r: (r.c1, r.s1, r.c2, r.s2))
    later = {i: [j for j in range(i + 1, len(order)) if (order[i].x - order[j].x) ** 2 + (order[i].y - order[j].y) ** 2 <= within**2] for i in range(len(order))}
    taken, groups = set(), []

    def take(k):
        if k in taken:
            return []
        taken.add(k)
        return [k, *(m for n in later[k] for m in take(n))]

    for k in range(len(order)):
        if k not in taken and any(n not in taken for n in later[k]):
            groups.append(take(k))
    every = [[k] for k in range(len(order)) if k not in taken] + groups
    return {n: (round(np.mean([order[k].x for k in g]), 9), round(np.mean([order[k].y for k in g]), 9), {(a, b) for k in g for a, b in ((order[k].c1, order[k].s1), (order[k].c2, order[k].s2))}) for n, g in enumerate(every)}


@pytest.mark.parametrize("together", [16384, 40])
def test_merge(spark, monkeypatch, together):
    monkeypatch.setattr(junctions, "TOGETHER", together)
    found = junctions.detect(drawings(spark))
    by = collections.defaultdict(list)
    for r in found.collect():
        by[r.drawing_id].append(r)
    got = collections.defaultdict(dict)
    for r in junctions.merge(found).collect():
        got[r.drawing_id][r.junction_id] = (round(r.x, 9), round(r.y, 9), {(m.contour_id, m.seg_id) for m in r.members})
    assert dict(got) == {d: plain_classes(rows) for d, rows in by.items()} and len(got[0]) > 100


def test_chain(spark):
    seg = drawings(spark)
    found, lengths = junctions.compute(seg), geometry.contour_lengths(seg)
    cross = [r for r in found.collect() if r.drawing_id == 9]
    assert [(r.type, round(r.x), round(r.y)) for r in cross] == [("X", 50, 50)]
    counts = junctions.type_counts(found)
    n = {r.drawing_id: r.n for r in counts.groupBy("drawing_id").agg(F.sum("n").alias("n")).collect()}
    whole = {r.drawing_id: r.l for r in lengths.groupBy("drawing_id").agg(F.sum("clen").alias("l")).collect()}
    for r in junctions.average(counts, lengths).collect():
        assert math.isclose(r.avg_junctions, n.get(r.drawing_id, 0) / whole[r.drawing_id] * 10000)
    by = collections.Counter((r.drawing_id, c) for r in found.collect() for c in {m.contour_id for m in r.members})
    ranked = junctions.criterion(found, lengths)
    assert {(r.drawing_id, r.contour_id): r.junctions for r in ranked.collect()} == {k: by.get(k, 0) for k in [(r.drawing_id, r.contour_id) for r in lengths.collect()]}
    assert split.split_by_properties(ranked, {"junctions": 1.0}).where("bottom AND top").count() <= 3
    parts = collections.defaultdict(float)
    for r in geometry.with_length(junctions.middles(seg.where("drawing_id = 9"), found.where("drawing_id = 9"))).collect():
        parts[r.contour_id, r.piece, r.part] += r.len
    assert {k: round(v, 6) for k, v in parts.items()} == {(c, p, n): s for c in (1, 2) for p in (0, 1) for n, s in (("head", 12.5), ("middle", 25.0), ("tail", 12.5))}


def test_lines_are_merged_and_cleared(spark):
    """A bent contour, its straight parts in pieces, and a shorter copy beside it."""
    bend = [(0.0, 0.0), (10.0, 0.2), (20.0, 0.0), (20.0, 10.0), (20.2, 20.0), (20.0, 30.0)]
    rows = [(1, c, k, *a, *b) for c, by in ((1, 0.0), (2, 0.3)) for k, (a, b) in enumerate((tuple(v + by for v in p), tuple(v + by * (c == 1 or k < 4) for v in q)) for k, (p, q) in enumerate(zip(bend, bend[1:], strict=False)))]
    rows = [(d, c, s, *map(float, r)) for d, c, s, *r in rows] + [(1, 3, 0, 50.0, 50.0, 60.0, 60.0)]
    got = split.merge_lines(spark.createDataFrame(rows, SEG), 0.5, 1.0).collect()
    left = {c: sorted((r.seg_id, r.x1, r.y1, r.x2, r.y2) for r in got if r.contour_id == c) for c in {r.contour_id for r in got}}
    assert len(left) == 2 and left[3] == [(0, 50.0, 50.0, 60.0, 60.0)]
    [kept] = [v for c, v in left.items() if c != 3]
    assert len(kept) == 2


def test_roots(spark):
    rng = np.random.default_rng(0)
    links = [(k, int(a), int(b)) for k in range(2) for a, b in rng.integers(0, 300, (200, 2))] + [(5, i, i + 1) for i in range(60)] + [(6, 0, i) for i in range(60)]
    got = {(r.k, r.node): r.root for r in roots(spark.createDataFrame(links, "k int, a bigint, b bigint"), ["k"]).collect()}
    root = {(k, n): n for k, a, b in links for n in (a, b) if a != b}
    for _ in range(100):
        for k, a, b in links:
            if a != b:
                root[k, a] = root[k, b] = min(root[k, a], root[k, b])
    assert got == root
    assert roots(spark.createDataFrame([], "k int, a bigint, b bigint"), ["k"]).count() == 0


@pytest.mark.parametrize("sigma", [0.5, 2, 30])
def test_smoothing(spark, sigma):
    h, w = 9, 70
    rng = np.random.default_rng(1)
    dense = np.where(rng.random((h, w)) < 0.05, rng.random((h, w)), 0)
    rows = [(1, int(y), int(x), float(dense[y, x]), 1.0) for y, x in zip(*np.nonzero(dense), strict=True)]
    got = stats.blurred(spark.createDataFrame(rows, "drawing_id bigint, y int, x int, a double, b double"), ["a", "b"], sigma, h, w)
    g = np.array(stats.gaussian(sigma))
    reach = len(g) // 2

    def mirror(q, n):
        while not 0 <= q < n:
            q = -q if q < 0 else 2 * n - 2 - q
        return q

    down = np.array([sum(g[k + reach] * dense[mirror(y + k, h)] for k in range(-reach, reach + 1)) for y in range(h)])
    want = np.stack([sum(g[k + reach] * down[:, mirror(x + k, w)] for k in range(-reach, reach + 1)) for x in range(w)], axis=1)
    out = np.zeros((h, w))
    for r in got.collect():
        out[r.y, r.x] = r.a
    assert np.allclose(out, want, atol=1e-9) and abs(g.sum() - 1) < 1e-12


def test_orientation_density(spark):
    pix = spark.createDataFrame([(1, 0, 0, 30.0, 1), (1, 0, 0, 210.0, 2), (1, 5, 5, 90.0, 1)], "drawing_id bigint, y int, x int, ori double, o int")
    got = {(r.y, r.x): round(r.value, 6) for r in stats.orientation_density(pix, "ori", "o", 0, 8, 8).collect()}
    assert got == {(0, 0): 60.0, (5, 5): 0.0}
    assert stats.orientation_density(pix, "ori", "o", 1, 8, 8).count() > 2


def test_branch_scores(spark):
    rows = [(1, 1, k, float(k), 5.0, 3.0) for k in range(12)] + [(1, 2, k, 10 * math.cos(k / 2), 10 * math.sin(k / 2), 2.0 + k) for k in range(12)]
    points = spark.createDataFrame(rows, "drawing_id bigint, contour_id bigint, pt bigint, x double, y double, r double")
    got = {n: {(r.contour_id, r.pt): r[n] for r in medial.branch_score(points, n).collect()} for n in medial.SCORES}
    for n in ("parallelism", "taper", "mirror"):
        assert all(abs(got[n][1, k] - 1) < 1e-9 for k in range(2, 10)) and abs(got[n][1, 0] - 0.5**10) < 1e-9
    assert all(abs(got["separation"][1, k] - (2 / 3) ** 10) < 1e-9 for k in range(12))
    assert got["mirror"][2, 5] < 0.9 and got["parallelism"][2, 5] < 0.9 and got["taper"][2, 5] > 0.99
    with pytest.raises(ValueError):
        medial.branch_score(points, "length")


def test_drawing_scores(spark):
    """Two parallel lines, and two that open like a wedge: the space between the former is more parallel."""
    rows = [(1, 1, 0, 10.0, 20.0, 90.0, 20.0), (1, 2, 0, 10.0, 34.0, 90.0, 34.0), (2, 1, 0, 10.0, 28.0, 90.0, 8.0), (2, 2, 0, 10.0, 32.0, 90.0, 52.0)]
    got = medial.drawing_scores(spark.createDataFrame(rows, SEG), 60, 100, ["parallelism", "mirror"], least=10).collect()
    found = {(r.drawing_id, r.contour_id, r.property): r.score for r in got}
    assert all(0 <= v <= 1 for v in found.values())
    assert min(found[1, c, "parallelism"] for c in (1, 2)) > 0.5 and {k[2] for k in found} == {"parallelism", "mirror"}


def test_null_tiles_start_from_the_middle(spark):
    rng = np.random.default_rng(2)
    pix = spark.createDataFrame([(k, int(y), int(x), 1.0) for k in range(3) for y, x in rng.integers(0, 32, (90, 2))], "raster_id bigint, y int, x int, strength double").distinct()
    path = "collection bigint, step bigint, image_idx bigint, ty int, tx int, ts int"
    rows = [(1, 0, 0, 0, 0, 16), (1, 1, 1, None, None, None), (1, 2, 2, 4, 4, 16)]
    given = [(1, 0, 0, 0, 0, 16), (1, 1, 1, 8, 8, 16), (1, 2, 2, 4, 4, 16)]
    null, full = (sorted(map(tuple, scan.refined_tiles(spark.createDataFrame(r, path), pix, 32, 32, [0.5, 0.5, 0.75], 2, 4).collect())) for r in (rows, given))
    assert null == full
