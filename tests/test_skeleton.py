"""Thinning, branches and borders against plain versions, in one block and in many."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeframe.operators import chains, raster, skeleton

AROUND = raster.NEIGHBOURS
H, W = 40, 56


def shapes():
    """Rasters of blobs, lines, rings, single pixels, and one that fills its raster."""
    rng = np.random.default_rng(5)
    out = {}
    for k in range(3):
        rough = rng.random((H, W))
        for _ in range(2):
            rough = sum(np.roll(np.roll(rough, a, 0), b, 1) for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
        out[k] = rough > np.quantile(rough, 0.6)
    lines = np.zeros((H, W), bool)
    lines[5, 3:50] = lines[2:30, 20] = lines[30, 30:33] = True
    for i in range(12):
        lines[15 + i, 30 + i] = True
    lines[35, 5] = lines[0, 0] = lines[39, 55] = True
    lines[10:15, 40] = lines[10:15, 44] = lines[10, 40:45] = lines[14, 40:45] = True  # a ring
    out[3] = lines
    noise = rng.random((H, W)) < 0.35
    out[4], out[5] = noise, np.ones((H, W), bool)
    return out


SHAPES = shapes()


def frame(spark, rasters, **more):
    rows = [(k, int(y), int(x)) for k, m in rasters.items() for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "raster_id int, y int, x int")


def pieces(mask, steps):
    left, n = set(zip(*np.nonzero(mask), strict=True)), 0
    while left:
        n, stack = n + 1, [left.pop()]
        while stack:
            y, x = stack.pop()
            for dy, dx in steps:
                if (y + dy, x + dx) in left:
                    left.remove((y + dy, x + dx))
                    stack.append((y + dy, x + dx))
    return n


def topology(mask):
    """The number of 8-connected pieces, and of 4-connected holes."""
    return pieces(mask, AROUND), pieces(~np.pad(mask, 1), [s for s in AROUND if 0 in s]) - 1


def masks(df):
    out = collections.defaultdict(lambda: np.zeros((H, W), bool))
    for r in df.collect():
        out[r.raster_id][r.y, r.x] = True
    return out


@pytest.mark.parametrize("rings", [False, True])
def test_follow(rings):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        ids, perm = np.sort(rng.choice(1000, n, replace=False)), rng.permutation(n)
        to = np.full(n, -1)
        for i in range(0, n, 5):
            part = perm[i : i + 5]
            to[part[:-1]] = part[1:]
            if rings:
                to[part[-1]] = part[0]
        end, steps, least, at = chains.follow(ids, to)
        for i in range(n):
            seen = [i]
            while to[seen[-1]] >= 0 and to[seen[-1]] != i:
                seen.append(to[seen[-1]])
            values = ids[seen].tolist()
            assert least[i] == min(values) and at[i] == values.index(min(values))
            assert end[i] == -1 if rings else (end[i], steps[i]) == (seen[-1], len(seen) - 1)


def test_thinning_keeps_pieces_and_holes(spark):
    df = frame(spark, SHAPES).withColumn("order", F.hash("y", "x").cast("double"))
    got = masks(skeleton.thinned(df, "order", H, W))
    rule = skeleton.removable()
    for k, m in SHAPES.items():
        assert topology(got[k]) == topology(m) and not (got[k] & ~m).any()
        inside = np.pad(got[k], 1)
        for y, x in zip(*np.nonzero(got[k]), strict=True):
            assert not rule[sum(1 << i for i, (dy, dx) in enumerate(AROUND) if inside[y + 1 + dy, x + 1 + dx])]
    assert skeleton.thinned(df.limit(0), "order", H, W).count() == 0
    # a thick line that weighs most in its middle becomes that middle
    bar = spark.createDataFrame([(0, y, x, -abs(y - 3.0)) for y in range(7) for x in range(30)], "raster_id int, y int, x int, order double")
    assert {r.y for r in skeleton.thinned(bar, "order", H, W).where("x BETWEEN 4 AND 25").collect()} == {3}


def walk(mask):
    """All branches of a raster as tuples of pixels, walked one by one."""
    on = set(zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True))
    near = {}
    for y, x in on:
        near[y, x] = [(y + a, x + b) for a, b in AROUND if (y + a, x + b) in on and (not a or not b or ((y + a, x) not in on and (y, x + b) not in on))]
    out, left = set(), {(p, q) for p in near for q in near[p]}
    for start in [p for p in near if len(near[p]) != 2]:
        if not near[start]:
            out.add((start,))
        for q in near[start]:
            if (start, q) in left:
                path = [start, q]
                while len(near[path[-1]]) == 2:
                    path.append(next(c for c in near[path[-1]] if c != path[-2]))
                left -= set(zip(path, path[1:], strict=False)) | set(zip(path[1:], path, strict=False))
                out.add(tuple(path))
    while left:
        path = list(min(left))
        while (c := next(c for c in near[path[-1]] if c != path[-2])) != path[0]:
            path.append(c)
        ring = [*path, path[0]]
        left -= set(zip(ring, ring[1:], strict=False)) | set(zip(ring[1:], ring, strict=False))
        out.add(("ring", *path))
    return out


def same(path):
    """A branch without its direction (a ring without its start)."""
    if path[0] == "ring":
        p = list(path[1:])
        i = p.index(min(p))
        turns = [p[i:] + p[:i], (p[i:] + p[:i])[:1] + (p[i:] + p[:i])[:0:-1]]
        return ("ring", *min(turns))
    return min(path, path[::-1])


@pytest.mark.parametrize("side", [8, 64])
def test_branches(spark, side):
    got = collections.defaultdict(dict)
    for r in skeleton.trace(frame(spark, SHAPES), H, W, side).collect():
        assert r.pt not in got[r.raster_id].setdefault(r.branch, {})
        got[r.raster_id][r.branch][r.pt] = (r.y, r.x)
    for k, m in SHAPES.items():
        found = []
        for b in got[k].values():
            assert sorted(b) == list(range(len(b)))
            found.append(tuple(b[i] for i in sorted(b)))
        want = collections.Counter(map(same, walk(m)))
        rings = {p[1:] for p in want if p[0] == "ring"}
        assert collections.Counter(("ring", *p) if (p := same(f)) in rings else same(("ring", *f)) if same(("ring", *f))[1:] in rings else p for f in found) == want
        assert {p for f in found for p in f} == set(zip(*map(np.ndarray.tolist, np.nonzero(m)), strict=True))


@pytest.mark.parametrize("side", [8, 64])
def test_borders(spark, side):
    got = collections.defaultdict(list)
    for r in skeleton.borders(frame(spark, SHAPES), H, W, side).collect():
        got[r.raster_id].append(r)
    for k, m in SHAPES.items():
        by = collections.defaultdict(dict)
        for r in got[k]:
            by[r.border, r.hole][r.pt] = (r.y, r.x)
        n, holes = topology(m)
        assert sum(not hole for _, hole in by) == n and sum(hole for _, hole in by) == holes
        for (_, hole), points in by.items():
            assert sorted(points) == list(range(len(points)))
            p = np.array([points[i] for i in range(len(points))])
            step = np.roll(p, -1, axis=0) - p
            assert np.abs(step).max(initial=0) <= 1
            if not hole:
                assert tuple(p[0]) == min(map(tuple, p))
        inside = np.pad(m, 1)
        rim = m & ~(inside[:-2, 1:-1] & inside[2:, 1:-1] & inside[1:-1, :-2] & inside[1:-1, 2:])
        assert {(r.y, r.x) for r in got[k]} == set(zip(*map(np.ndarray.tolist, np.nonzero(rim)), strict=True))


def test_polygons(spark):
    disc = {1: np.hypot(*np.mgrid[-15:16, -20:21]) < 13, 2: np.zeros((31, 41), bool)}
    disc[2][3:20, 4:30] = True
    disc[2][8:12, 10:20] = False
    pix = frame(spark, disc).withColumn("strength", F.when(F.col("x") % 2 == 0, 1.0).otherwise(0.2))
    seg = skeleton.vectorize(pix, 31, 41).collect()
    square = [(s.x1, s.y1) for s in sorted(seg, key=lambda s: (s.contour_id, s.seg_id)) if s.drawing_id == 2]
    assert set(square) | {(s.x2, s.y2) for s in seg if s.drawing_id == 2} >= {(4.0, 3.0), (29.0, 3.0), (29.0, 19.0), (4.0, 19.0)}
    assert len({s.contour_id for s in seg if s.drawing_id == 2}) == 2
    assert 8 <= sum(s.drawing_id == 1 for s in seg) < 30
    # without tolerance the lines paint the border, but for the last one, which closes it
    exact = skeleton.vectorize(pix, 31, 41, epsilon=0.0)
    painted = {(r.drawing_id, r.y, r.x) for r in raster.lines_to_pixels(exact).collect()}
    rim = {(r.raster_id, r.y, r.x) for r in skeleton.borders(pix, 31, 41).collect()}
    assert painted <= rim and len(painted) > 0.75 * len(rim)
    assert skeleton.vectorize(pix.withColumn("strength", F.lit(0.1)), 31, 41).count() == 0


def test_simplified():
    square = np.array([(0, 0), (0, 5), (0, 10), (5, 10.4), (10, 10), (10, 0), (5, -3)], float)
    assert [tuple(p) for p in skeleton.simplified(square, 1.0)] == [(0, 0), (0, 10), (10, 10), (10, 0), (5, -3)]


@pytest.mark.parametrize("side", [8, 64])
def test_components_in_blocks(spark, side):
    got = raster.components(frame(spark, SHAPES), H, W, side).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.raster_id, r.label].add((r.y, r.x))
    for k, m in SHAPES.items():
        mine = {label: p for (r, label), p in by.items() if r == k}
        assert len(mine) == pieces(m, AROUND) and all(label == min(y * W + x for y, x in p) for label, p in mine.items())
    large = raster.large_components(frame(spark, SHAPES), H, W, 5, side)
    assert {(r.raster_id, r.y, r.x) for r in large.collect()} == {(k, y, x) for (k, _), p in by.items() if len(p) >= 5 for y, x in p}


@pytest.mark.parametrize("side", [8, 64])
def test_stencils_in_blocks(spark, side):
    """Gradients and thinning against plain loops."""
    rng = np.random.default_rng(9)
    dense = {k: np.where(m, rng.integers(1, 9, m.shape), 0.0) for k, m in SHAPES.items()}
    rows = [(k, int(y), int(x), float(v[y, x])) for k, v in dense.items() for y, x in np.argwhere(v)]
    pix = spark.createDataFrame(rows, "raster_id int, y int, x int, strength double")
    flipped = [list(r) for r in zip(*raster.SOBEL, strict=True)]
    g = raster.scatter(pix, {"gx": raster.SOBEL, "gy": flipped}, H, W, side).withColumn("mag", F.abs("gx") + F.abs("gy"))
    got = {(r.raster_id, r.y, r.x): (r.gx, r.gy, r.mag) for r in g.collect()}
    want = {}
    for k, v in dense.items():
        p = np.pad(v, 1)
        for y in range(H):
            for x in range(W):
                part = p[y : y + 3, x : x + 3]
                if part.any():
                    gx, gy = (part * raster.SOBEL).sum(), (part * flipped).sum()
                    want[k, y, x] = (gx, gy, abs(gx) + abs(gy))
    assert got == want
    kept = {(r.raster_id, r.y, r.x) for r in raster.thin(g, H, W, side).collect()}
    steps = {0: (0, 1), 1: (1, -1), 2: (1, 0), 3: (1, 1)}
    plain = set()
    for (k, y, x), (gx, gy, mag) in want.items():
        a = round(float(np.degrees(np.arctan2(gy, gx))) % 180, 9)
        dy, dx = steps[1 if 22.5 <= a < 67.5 else 2 if 67.5 <= a < 112.5 else 3 if 112.5 <= a < 157.5 else 0]
        if all(mag >= want.get((k, y + s * dy, x + s * dx), (0, 0, 0))[2] for s in (-1, 1)):
            plain.add((k, y, x))
    assert kept == plain
