"""Edge chains, components, tile scans, refinement and medial axes against plain versions and known answers."""

import numpy as np
import pytest

from strokeframe.operators import distance, medial, photo, raster, scan, stats
from strokeframe.sources import files, svg

PIXELS = "raster_id bigint, y bigint, x bigint, strength double"


def pixels(spark, *images):
    rows = [(k, int(y), int(x), float(m[y, x])) for k, m in enumerate(images) for y, x in np.argwhere(m > 0)]
    return spark.createDataFrame(rows, PIXELS)


def spotted(seed: int, h: int, w: int, share: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.random((h, w)) < share) * rng.uniform(0.5, 1.0, (h, w))


def plain_distance(m: np.ndarray) -> np.ndarray:
    on = np.argwhere(m > 0)
    ys, xs = np.indices(m.shape)
    return np.sqrt(((ys[..., None] - on[:, 0]) ** 2 + (xs[..., None] - on[:, 1]) ** 2).min(axis=-1))


def plain_labels(m: np.ndarray) -> dict:
    left, out = {tuple(p) for p in np.argwhere(m > 0).tolist()}, {}
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        name = todo[0][0] * m.shape[1] + todo[0][1]
        while todo:
            y, x = todo.pop()
            out[y, x] = name
            for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    todo.append(q)
    return out


@pytest.mark.parametrize("share", [0.1, 0.4, 0.7])
def test_components(spark, share):
    images = [spotted(s, 17, 23, share) for s in range(3)]
    spiral = np.zeros((17, 23))
    spiral[::2, :] = 1
    for k, y in enumerate(range(1, 17, 2)):
        spiral[y, -1 if k % 2 == 0 else 0] = 1
    got = raster.components(pixels(spark, *images, spiral), 17, 23).collect()
    for k, m in enumerate([*images, spiral]):
        assert {(r.y, r.x): r.label for r in got if r.raster_id == k} == plain_labels(m)


def test_components_keep_repeated_rows(spark):
    pix = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 0, 1.0), (0, 0, 22, 1.0), (0, 1, 0, 1.0)], PIXELS)
    assert sorted((r.y, r.x, r.label) for r in raster.components(pix, 17, 23).collect()) == [(0, 0, 0), (0, 0, 0), (0, 22, 22), (1, 0, 0)]


def test_nearest_cells():
    for seed in range(5):
        m = spotted(seed, 13, 19, 0.05 + seed / 20)
        on = np.argwhere(m > 0)
        if not len(on):
            continue
        d, place = distance.nearest_cells(on, 13, 19)
        for y in range(13):
            for x in range(19):
                best = min(((y - a) ** 2 + (x - b) ** 2, a * 19 + b) for a, b in on.tolist())
                assert (d[y, x], place[y, x]) == best


def test_resized_keeps_the_mean_and_empty_tables(spark):
    m = spotted(1, 6, 9, 0.5)
    got = photo.resized(pixels(spark, m), 6, 9, 4, 6).collect()
    assert sum(r.strength for r in got) / 24 == pytest.approx(m.mean())
    small = {(r.y, r.x): r.strength for r in photo.resized(pixels(spark, m), 6, 9, 2, 3).collect()}
    for y in range(2):
        for x in range(3):
            assert small.get((y, x), 0.0) == pytest.approx(m[3 * y : 3 * y + 3, 3 * x : 3 * x + 3].mean())
    none = spark.createDataFrame([], PIXELS)
    assert photo.cleaned_edges(none, 6, 9).count() == 0 and photo.canny_edges(none, 6, 9).count() == 0


def test_cleaned_edges(spark):
    m = np.zeros((8, 8))
    m[1, 1:5] = [0.7, 0.9, 0.8, 0.65]
    m[4, 4] = 1.0  # alone
    m[6, 0:4] = 0.5  # too weak
    got = {(r.y, r.x): r.strength for r in photo.cleaned_edges(pixels(spark, m), 8, 8, least=3).collect()}
    assert got == {(1, x): pytest.approx((m[1, x] / 0.9) ** 1.5) for x in range(1, 5)}


def test_canny_holds_weak_edges_that_touch_strong_ones(spark):
    m = np.zeros((12, 24))
    m[:, 4:12] = 40.0
    m[6:, 4:12] = 100.0
    m[:, 18:] = 40.0
    got = {(r.y, r.x) for r in photo.canny_edges(pixels(spark, m), 12, 24, 120, 300).collect()}
    assert any(x in (3, 4) and y < 4 for y, x in got) and not any(x in (17, 18) and 2 < y < 9 for y, x in got)


def plain_scan(a, b, y, x, size, stride):
    da, db, h, w = plain_distance(a), plain_distance(b), *a.shape
    out = {}
    for j in range(0, h - size, stride):
        for i in range(0, w - size, stride):
            t, u = a[y : y + size, x : x + size] > 0, b[j : j + size, i : i + size] > 0
            if u.any():
                there = db[j : j + size, i : i + size][t].max() if t.any() else 0.0
                out[j, i] = max(there, da[y : y + size, x : x + size][u].max())
    return out


def test_scan_costs_and_chain(spark):
    images = [spotted(s, 16, 20, 0.08) for s in range(5)]
    pix = pixels(spark, *images)
    asked = spark.createDataFrame([(0, 3, 5, 1), (2, 0, 0, 4)], "i bigint, yi int, xi int, j bigint")
    got = scan.scan_costs(pix, asked, 16, 20, 8, 2).collect()
    for i, y, x, j in ((0, 3, 5, 1), (2, 0, 0, 4)):
        assert {(r.yj, r.xj): round(r.cost, 9) for r in got if r.i == i} == {k: round(v, 9) for k, v in plain_scan(images[i], images[j], y, x, 8, 2).items()}
    members = spark.createDataFrame([(7, k) for k in range(6)], "collection bigint, image_idx bigint")  # the sixth has no pixel
    rows = scan.scan_chain(pix, members, 16, 20, 8, 2, (3, 5)).orderBy("step").collect()
    here, y, x, left = 0, 3, 5, [1, 2, 3, 4]
    for r in rows[:4]:
        best = min((round(c, 9), k, p) for k in left for p, c in plain_scan(images[here], images[k], y, x, 8, 2).items())
        assert (round(r.cost, 9), r.image_idx, (r.ty, r.tx)) == best
        here, (y, x) = best[1], best[2]
        left.remove(here)
    assert [(r.image_idx, r.ty, r.cost) for r in rows[4:]] == [(5, None, None)]


def test_refined_tiles_find_a_shifted_copy(spark):
    m = np.zeros((40, 48))
    m[8:32, 10:34] = spotted(3, 24, 24, 0.1)
    moved = np.roll(m, (4, 6), (0, 1))
    path = spark.createDataFrame([(1, 0, 0, 8, 10, 24), (1, 1, 1, 8, 10, 24)], "collection bigint, step bigint, image_idx bigint, ty int, tx int, ts int")
    rows = scan.refined_tiles(path, pixels(spark, m, moved), 40, 48, [0.6], 1, 8).orderBy("step").collect()
    assert rows[0].total == 0 and (rows[1].ty - rows[0].ty, rows[1].tx - rows[0].tx) == (4, 6)
    alone = scan.refined_tiles(path.where("step = 0"), pixels(spark, m), 40, 48, [0.6]).collect()
    assert [(r.ty, r.tx, r.ts, r.total) for r in alone] == [(8, 10, 24, 0.0)]
    blank = scan.refined_tiles(path.where("step = 0").unionByName(path.where("step = 1").replace(1, 9, ["image_idx"])), pixels(spark, m), 40, 48, [0.6]).collect()
    assert len(blank) == 2 and blank[0].total == float("inf")


def test_medial_axis_of_a_bar(spark):
    m = np.zeros((21, 61))
    m[5:16, 5:56] = 1
    rows = medial.medial_axis(pixels(spark, m), 21, 61, least=10).collect()
    middle = [r for r in rows if 14 <= r.x <= 46]
    # the middle row is as near to both sides, and its ties go to the upper one: the axis is two pixels thick
    assert {r.x for r in middle if r.y == 10 and r.r == 6} == set(range(14, 47)) and {r.y for r in middle} <= {10, 11}


def test_tangents_and_their_scores(spark):
    points = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 5.0, 0.3), (1, 1, 1, 10.0, 0.0, 5.0, 0.3), (1, 2, 0, 0.0, 2.0, 5.0, 0.9), (1, 2, 1, 10.0, 2.0, 5.0, 0.9)], "drawing_id bigint, contour_id bigint, pt bigint, x double, y double, r double, score double")
    tangents = medial.tangent_points(points)
    assert tangents.count() == 2 * 18
    assert {(round(r.fx, 6), round(r.fy, 6)) for r in tangents.where("contour_id = 1").collect() if abs(abs(r.fy) - 5) < 1e-9} >= {(5.0, 5.0), (5.0, -5.0)}
    asked = spark.createDataFrame([(1, 5.0, 5.5), (1, 5.0, -8.5), (1, 50.0, 50.0)], "drawing_id bigint, x double, y double")
    got = {(r.x, r.y): r.score for r in medial.scores_to_points(asked, tangents).collect()}
    assert got == {(5.0, 5.5): 0.9, (5.0, -8.5): 0.3}
    one = medial.tangent_points(points.where("pt = 0").unionByName(points.where("pt = 0").replace(0, 1, ["pt"]))).where("contour_id = 2").select("fx", "fy").distinct().collect()
    assert [tuple(r) for r in one] == [(0.0, 2.0)]


def test_scenes_sizes_and_names(spark):
    scenes = spark.createDataFrame([(1, "city"), (2, "beach")], "drawing_id bigint, category string")
    hist = spark.createDataFrame([(1, 0, 4.0), (1, 3, 2.0)], "drawing_id bigint, bin int, norm_value double")
    got = {r.category: (r.len_1, r.len_4, r.len_2) for r in stats.scene_table(scenes, {"len": (hist, [0, 1, 2, 3])}).collect()}
    assert got == {"city": (4.0, 2.0, 0.0), "beach": (0.0, 0.0, 0.0)}
    text = b'<svg viewBox="0 0 10 20"><line x1="0" y1="0" x2="5" y2="5"/></svg>'
    assert svg.parse(text)[1:] == (10, 20) and svg.parse(text, size_as=(64, 48))[1:] == (64, 48)
    listing = spark.createDataFrame([("a", 1), ("b", 2)], "filename string, step int")
    drawings = spark.createDataFrame([("a", 7)], "filename string, drawing_id int")
    assert sorted((r.filename, r.drawing_id) for r in files.drawings_by_name(listing, drawings).collect()) == [("a", 7), ("b", None)]
