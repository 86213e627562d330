"""Queries that were rewritten for larger tables: their operators against plain versions, in blocks of any size."""

import math

import numpy as np
import pytest

from strokeframe.operators import distance, drawings, geometry, junctions, raster, stats


def random_pixels(rasters, h=12, w=15, seed=1):
    """{raster: {(y, x): strength}} with rasters of many, few and no pixels."""
    rng = np.random.default_rng(seed)
    made = {}
    for k in rasters:
        on = np.argwhere(rng.random((h, w)) < rng.choice([0.02, 0.2, 0.6]))
        made[k] = {(int(y), int(x)): float(rng.integers(1, 9)) / 8 for y, x in on}
    return made


def pixel_rows(spark, made):
    rows = [(k, y, x, s) for k, p in made.items() for (y, x), s in p.items()]
    return spark.createDataFrame(rows, "raster_id bigint, y bigint, x bigint, strength double")


def tile_of(p, ty, tx, size):
    return {(y - ty, x - tx): s for (y, x), s in p.items() if 0 <= y - ty < size and 0 <= x - tx < size}


def nearest(a, b):
    return {k: min(((k[0] - y) ** 2 + (k[1] - x) ** 2) ** 0.5 for y, x in b) for k in a}


def both_ways(a, b):
    """(chamfer, hausdorff) of two tiles."""
    ways = [(nearest(p, q), p) for p, q in ((a, b), (b, a))]
    return sum(sum(d[k] * p[k] for k in p) / sum(p.values()) for d, p in ways) / 2, max(max(d.values()) for d, _ in ways)


@pytest.mark.parametrize("places", [1, 12 * 15 * 3, 1 << 17])
def test_tiles_beside(spark, places):
    made = random_pixels([-1, 0, 1, 2, 3, 5, 6, 7, 8, 100, 101])
    found = {(r.raster_id, r.ty, r.tx): (r.cost, r.h) for r in distance.tiles_beside(pixel_rows(spark, made), 12, 15, 8, 2, places).collect()}
    expected = {}
    for k in made:
        for ty in (0, 2, 4):
            for tx in (0, 2, 4, 6):
                a, b = (tile_of(made.get(m, {}), ty, tx, 8) for m in (k, k + 1))
                if a and b:
                    expected[k, ty, tx] = both_ways(a, b)
    assert expected and found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k]) for k in expected)


NAMES = "drawing_id bigint, contour_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double"


def random_drawings(spark, sizes, seed=3, side=60):
    """Contours of one to six segments with whole places, ``sizes`` of them in each drawing, and some that touch."""
    rng = np.random.default_rng(seed)
    rows = []
    for drawing, contours in sizes.items():
        for c in range(contours):
            p = rng.integers(0, side, (int(rng.integers(2, 8)), 2)).astype(float)
            rows += [(drawing, drawing * 100 + c, k, *p[k].tolist(), *p[k + 1].tolist()) for k in range(len(p) - 1)]
    return spark.createDataFrame(rows, NAMES)


def rows_of(df, digits=9):
    flat = lambda v: tuple(flat(x) for x in v) if isinstance(v, (list, tuple)) else round(v, digits) + 0.0 if isinstance(v, float) else v
    return sorted((flat(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def seg(spark):
    return random_drawings(spark, {1: 12, 2: 1, 5: 30, 9: 20}).cache()


def old_typed(seg):
    return junctions.angles_and_types(junctions.as_junctions(junctions.detect_in_cells(seg)), seg)


@pytest.mark.parametrize("together", [2048, 60, 0])
def test_meetings_of_whole_drawings(spark, seg, together):
    """In one task, by the operators on tables, and some drawings each way."""
    assert rows_of(junctions.detect(seg, together=together)) == rows_of(junctions.detect_in_cells(seg))
    old = old_typed(seg)
    found = junctions.typed_meetings(seg, together)
    assert rows_of(found) == rows_of(old.select(*found.columns)) and found.count()
    assert rows_of(junctions.meeting_types(seg, together)) == rows_of(junctions.type_counts(old))
    assert rows_of(junctions.meeting_angles(seg, together=together)) == rows_of(junctions.angle_histogram(old))
    assert rows_of(junctions.meeting_contours(seg, together), 6) == rows_of(junctions.contour_type_counts(old, geometry.contour_lengths(seg)), 6)


@pytest.mark.parametrize("held", [1, 1 << 22])
def test_tile_pairs_that_are_picked(spark, monkeypatch, held):
    monkeypatch.setattr(distance, "HELD", held)
    made = random_pixels([0, 1, 2, 3, 70], seed=5)
    tiles = [(k, ty, tx, 8) for k in made for ty in (0, 4) for tx in (0, 3, 7)]
    pairs = [(0, 1), (0, 3), (1, 2), (2, 70), (3, 70), (3, 99)]
    told = lambda pick: [tuple(r) for r in distance.tile_pair_costs(pixel_rows(spark, made), spark.createDataFrame(tiles, "raster_id bigint, ty int, tx int, ts int"), spark.createDataFrame(pairs, "i bigint, j bigint"), 8, pick).collect()]
    expected = {}
    for i, j in pairs:
        for _, yi, xi, _ in (t for t in tiles if t[0] == i):
            for _, yj, xj, _ in (t for t in tiles if t[0] == j):
                a, b = tile_of(made[i], yi, xi, 8), tile_of(made[j], yj, xj, 8)
                if a and b:
                    expected[i, j, yi, xi, yj, xj] = round(both_ways(a, b)[0], 9)
    assert {r[:6]: round(r[6], 9) for r in told("all")} == pytest.approx(expected)
    best, arrival = {}, {}
    for k in sorted(expected):
        for found, key in ((best, k[:2]), (arrival, k[:4])):
            if key not in found or expected[k] < expected[found[key]]:
                found[key] = k
    assert {r[:6] for r in told("best")} == set(best.values())
    assert {r[:6] for r in told("arrival")} == set(arrival.values())


@pytest.mark.parametrize("together", [2048, 60])
def test_merged_meetings_of_whole_drawings(spark, seg, together):
    cells = junctions.detect_in_cells(seg)
    assert rows_of(junctions.meeting_pairs(seg, together=together)) == rows_of(junctions.merge_pairs(cells))
    old = junctions.merge(cells)
    assert rows_of(junctions.merged_meetings(seg, together=together), 6) == rows_of(old, 6)
    assert any(len(r.members) > 4 for r in old.collect())
    assert rows_of(junctions.compute(seg, together=together), 5) == rows_of(junctions.angles_and_types(old, seg), 5)


@pytest.mark.parametrize(("together", "laid"), [(2048, 1 << 24), (2048, 0), (60, 1 << 24)])
def test_painted_drawings(spark, seg, monkeypatch, together, laid):
    monkeypatch.setattr(drawings, "LAID", laid)
    last, count = {}, {}
    for r in sorted(seg.collect(), key=lambda r: (r.drawing_id, r.contour_id, r.seg_id)):
        n = int(max(abs(r.x2 - r.x1), abs(r.y2 - r.y1)))
        for k in range(n + 1):
            at = [math.floor(a + (b - a) * k / max(n, 1) + 0.5) for a, b in ((r.y1, r.y2), (r.x1, r.x2))]
            last[r.drawing_id, *at] = math.hypot(r.x2 - r.x1, r.y2 - r.y1)
    for (d, y, x), v in last.items():
        a = count.setdefault((d, y), [0, 0, 0, 0.0, 0.0])
        count[d, y] = [a[0] + 1, a[1] + x, a[2] + x * x, a[3] + v, a[4] + v * x]
    assert {(r.drawing_id, r.y): [r.n, r.sx, r.sxx] for r in raster.painted_rows(seg, together).collect()} == {k: v[:3] for k, v in count.items()}
    found = {(r.drawing_id, r.y): (r.n, r.value, r.moment) for r in stats.density_rows(seg, together).collect()}
    assert found.keys() == count.keys()
    assert all(found[k][0] == v[0] and abs(found[k][1] - v[3]) < 0.006 and abs(found[k][2] - v[4]) < 0.51 for k, v in count.items())
