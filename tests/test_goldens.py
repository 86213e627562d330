"""Small drawings with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeframe.operators import distance, raster, search, split
from strokeframe.operators import geometry as geo
from strokeframe.operators import junctions as jun
from strokeframe.sources import files, svg

SCHEMA = "drawing_id bigint, contour_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double"


def drawing(spark, *contours):
    rows = [(1, c, s, *map(float, p[s]), *map(float, p[s + 1])) for c, p in enumerate(contours) for s in range(len(p) - 1)]
    return spark.createDataFrame(rows, SCHEMA)


def typed(spark, *contours):
    seg = drawing(spark, *contours)
    return jun.angles_and_types(jun.merge(jun.detect(seg)), seg).collect()


def test_square(spark):
    rows = geo.with_properties(drawing(spark, [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])).orderBy("seg_id").collect()
    assert [round(r.ori) for r in rows] == [0, 270, 180, 90]
    assert [round(r.curv, 6) for r in rows] == [9.0] * 4 and sum(r.len for r in rows) == 40


def test_single_segment_and_unknown_property(spark):
    seg = drawing(spark, [(0, 0), (5, 5)])
    assert geo.with_properties(seg, ["Curvature"]).first().curv == 0
    with pytest.raises(ValueError):
        geo.with_properties(seg, ["colour"])


def test_crossing_diagonals(spark):
    (j,) = typed(spark, [(0, 0), (20, 20)], [(0, 20), (20, 0)])
    assert (j.x, j.y, j.type, round(j.min_angle)) == (10, 10, "X", 90)


def test_t_and_parallel(spark):
    (j,) = typed(spark, [(0, 10), (20, 10)], [(10, 10), (10, 30)])
    assert j.type == "T" and round(j.max_angle) == 180
    assert jun.detect(drawing(spark, [(0, 0), (10, 0)], [(10, 0), (20, 0)])).count() == 0


def test_star_y_arrow(spark):
    def spokes(*degrees):
        return [[(100, 100), (100 + 40 * np.cos(np.radians(d)), 100 - 40 * np.sin(np.radians(d)))] for d in degrees]

    assert [j.type for j in typed(spark, *spokes(0, 120, 240))] == ["Y"]
    assert [j.type for j in typed(spark, *spokes(0, 60, 140))] == ["Arrow"]
    assert [j.type for j in typed(spark, *spokes(0, 72, 144, 216, 288))] == ["Star"]


def test_merge_is_not_transitive(spark):
    """Of three in a row where the first and second both reach only the third, the second stays."""
    rows = [(1, 0, 0, 9, 0, 0.0, 0.0), (1, 0, 1, 9, 1, 3.0, 0.0), (1, 0, 2, 9, 2, 1.5, 0.0)]
    found = spark.createDataFrame(rows, "drawing_id bigint, c1 bigint, s1 bigint, c2 bigint, s2 bigint, x double, y double")
    merged = jun.merge(found).orderBy("junction_id").collect()
    assert [(m.x, len(m.members)) for m in merged] == [(3.0, 2), (0.75, 4)]


def test_aperture(spark):
    seg = drawing(spark, [(0, 50), (40, 50), (50, 50), (100, 50)])
    rows = geo.clip_to_circle(seg, 100, 100, 20).orderBy("seg_id").collect()
    assert [(r.piece, r.x1, r.x2) for r in rows] == [(1, 30, 40), (2, 40, 50), (2, 50, 70)]


def test_middle_and_ends_keep_the_length(spark):
    seg = drawing(spark, [(0, 0), (30, 0), (30, 50)])
    parts = {r.part: r.n for r in geo.with_length(geo.middle_and_ends(seg)).groupBy("part").agg(F.round(F.sum("len"), 6).alias("n")).collect()}
    assert parts == {"head": 20, "middle": 40, "tail": 20}


def test_split_at_junctions_and_runs(spark):
    seg = drawing(spark, [(0, 0), (20, 0)])
    at = spark.createDataFrame([(1, 0, 0, 5.0, 0.0), (1, 0, 0, 15.0, 0.0)], "drawing_id bigint, contour_id bigint, seg_id bigint, x double, y double")
    pieces = split.split_at_junctions(seg, at).orderBy("piece").collect()
    assert [(p.x1, p.x2) for p in pieces] == [(0, 5), (5, 15), (15, 20)]
    assert split.merge_straight_runs(drawing(spark, [(0, 0), (5, 0.1), (10, 0), (10, 10)]), 1.0).count() == 2


def test_distance_map_matches_the_join(spark):
    rng = np.random.default_rng(0)
    pts = rng.integers(0, 16, (9, 2))
    grid = spark.range(16).select(F.lit(1).alias("k"), F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
    ones = spark.createDataFrame([(1, int(y), int(x)) for y, x in pts], "k int, y bigint, x int")
    got = {(r.y, r.x): r.d for r in distance.nearest(grid, ones, ["k"]).collect()}
    want = distance.distance_map(pts, 16)
    assert all(abs(got[y, x] - want[y, x]) < 1e-9 for y in range(16) for x in range(16))


def test_path_is_a_permutation_and_two_opt_never_worsens():
    rng = np.random.default_rng(1)
    p = rng.random((30, 2))
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    d = search.Costs.of(d)
    first = search.greedy(d, 0)
    better = search.two_opt(d, first)
    assert sorted(better) == list(range(30)) and search.total(d, better) <= search.total(d, first) + 1e-9


def test_components(spark):
    pix = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, 1.0), (1, 5, 5, 1.0), (1, 5, 6, 1.0), (1, 6, 7, 1.0)], "raster_id bigint, y bigint, x bigint, strength double")
    assert sorted(r.label for r in raster.components(pix, 8, 8).collect()) == [0, 0, 45, 45, 45]
    assert raster.large_components(pix, 8, 8, 3).count() == 3


def test_centre_tile_when_none_fits(spark):
    r = spark.createDataFrame([(1, 12, 40)], "raster_id bigint, h int, w int")
    (t,) = raster.tile_grids(r, [0.5, 1.0], 4).collect()
    assert (t.ts, t.ty, t.tx) == (16, -2, 12)  # the least size, about the middle


SVG = """<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 50"><g transform="translate(10,0)"><line x1="0" y1="0" x2="5" y2="0"/>
<path d="M0 0 h10 v10 z m20,0 L 25 5 30 0"/></g><rect x="1" y="1" width="2" height="3"/><circle cx="50" cy="25" r="10"/>
<path d="M0,0 Q10,10 20,0 T40,0 C 50 10 60 10 70 0 A 5 5 0 0 1 80 0"/></svg>"""


def test_svg(spark, tmp_path):
    contours, w, h = svg.parse(SVG.encode())
    assert (w, h) == (100, 50)
    assert contours[0].tolist() == [[10, 0], [15, 0]]
    assert contours[1].tolist() == [[10, 0], [20, 0], [20, 10], [10, 0]]
    assert contours[2].tolist() == [[30, 0], [35, 5], [40, 0]]
    assert len(contours[3]) == 5 and len(contours[4]) == 14 and contours[5][-1].tolist() == [80, 0]
    (tmp_path / "a.svg").write_text(SVG)
    (tmp_path / "b.svg").write_text("<svg")
    rows = svg.read_svg(spark, str(tmp_path)).collect()
    assert {r.filename for r in rows if r.error} == {"b.svg"} and sum(r.filename == "a.svg" for r in rows) == sum(len(c) - 1 for c in contours)


def test_sequence_listing_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b.jpg", 5, 10, 512, 682), (0, "a.jpg", 0, 0, 512, 682)], "step int, " + files.SEQUENCE)
    files.write_sequence(rows, str(tmp_path / "s"))
    back = files.read_sequence(spark, str(tmp_path / "s")).orderBy("step").collect()
    assert [(r.filename, r.tile_x) for r in back] == [("a.jpg", 0), ("b.jpg", 10)]


def test_first_existing_photo(spark):
    have = spark.createDataFrame([("a.png",), ("a.jpg",), ("c.gif",)], "filename string")
    want = spark.createDataFrame([("a.svg",), ("c.gif",), ("d.svg",)], "filename string")
    assert {r.filename: r.photo for r in files.first_existing(want, have).collect()} == {"a.svg": "a.jpg", "c.gif": "c.gif", "d.svg": None}


def test_svg_stream(spark, tmp_path):
    from strokeframe.streaming import drawings

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.svg").write_text(SVG)
    stats = drawings.orientation_histograms(drawings.svg_stream(spark, str(tmp_path / "in")))
    q = stats.writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM hist").count() > 0


def test_squared_distances():
    rng = np.random.default_rng(5)
    for h, w, n in ((1, 1, 1), (1, 9, 2), (9, 1, 1), (13, 40, 1), (24, 24, 30), (40, 17, 3)):
        p = np.stack([rng.integers(0, h, n), rng.integers(0, w, n)], 1)
        y, x = np.indices((h, w))
        plain = ((y[..., None] - p[:, 0]) ** 2 + (x[..., None] - p[:, 1]) ** 2).min(axis=2)
        assert (distance.squared_distances(p, h, w) == plain).all()


def test_nearest_pixel_and_point_agree(spark):
    rng = np.random.default_rng(6)
    a, b = (spark.createDataFrame([(int(k % 3), int(y), int(x), 1.0) for k, (y, x) in enumerate(rng.integers(-5, 30, (n, 2)))], "raster_id bigint, y bigint, x bigint, strength double").distinct() for n in (40, 25))
    b = b.where("raster_id < 2")  # a raster without partners is left out
    first, second = (sorted(map(tuple, f(a, b, ["raster_id"]).collect())) for f in (distance.nearest, distance.nearest_point))
    assert first == second and {r[0] for r in first} == {0, 1}


def _plain_tile_greedy(n, tiles, cost, absent):
    """cost[(i, p, j, q)] of both orders; every start, the cheapest total, ties to the first."""
    best = None
    for start in range(n):
        path, at, total = [start], {}, 0.0
        while len(path) < n:
            here = path[-1]
            own = [at[here]] if here in at else range(tiles)
            steps = [(cost.get((here, p, j, q), absent), j, p, q) for j in range(n) if j not in path for p in own for q in range(tiles)]
            c, j, p, q = min(steps)
            total += c
            path.append(j)
            if c < absent:
                at[here], at[j] = p, q
        if best is None or total < best[2]:
            best = (path, at, total)
    return best


def test_tile_sequence(spark):
    rng = np.random.default_rng(7)
    n, tiles = 9, 3
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
    rows = [(i, j, 0, 4 * p, 0, 4 * q, float(rng.integers(1, 100))) for i, j in pairs for p in range(tiles) for q in range(tiles)]
    members = spark.createDataFrame([(1, k) for k in range(n)] + [(2, 50)], "collection bigint, image_idx bigint")
    costs = spark.createDataFrame(rows, "i bigint, j bigint, yi int, xi int, yj int, xj int, cost double")
    known = {(i, xi // 4, j, xj // 4): c for i, j, _, xi, _, xj, c in rows}
    known |= {(j, q, i, p): c for (i, p, j, q), c in known.items()}
    absent = sum(r[6] for r in rows) + 1
    path, at, total = _plain_tile_greedy(n, tiles, known, absent)
    got = search.tile_sequence(members, costs, improve=False).orderBy("collection", "step").collect()
    assert [(r.image_idx, r.tx) for r in got if r.collection == 1] == [(k, 4 * at[k] if k in at else None) for k in path]
    assert [(r.image_idx, r.ty) for r in got if r.collection == 2] == [(50, None)]  # an image alone has no tile
    better = search.tile_sequence(members, costs)
    assert sorted(r.image_idx for r in better.where("collection = 1").collect()) == list(range(n))
    sums = [{r.collection: r.cost for r in search.tile_path_cost(p, costs, F.lit(absent)).collect()} for p in (search.tile_sequence(members, costs, improve=False), better)]
    assert abs(sums[0][1] - total) < 1e-9 and sums[1][1] <= sums[0][1] and 2 not in sums[0]
    assert search.tile_sequence(members.limit(0), costs).count() == 0
    assert search.tile_sequence(members, costs.limit(0)).count() == n + 1
