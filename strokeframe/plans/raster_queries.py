"""Queries over rasters, tiles, vectors and paths, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from strokeframe.operators import distance, inverted, raster, search, sequence
from strokeframe.tables import read_table

from . import line_queries
from .fixtures import RASTER_H, RASTER_W, SQL, descriptors, pixels, raw_pixels, segments, sizes

QUERIES: dict[str, line_queries.Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, digits: int = 4):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: line_queries.rounded(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLE[name] = SQL + sql
        return f

    return keep


def rasters(spark, sf):
    """(raster_id, h, w) of all rasters."""
    return pixels(spark, sf).select("raster_id").distinct().select("raster_id", F.lit(RASTER_H).alias("h"), F.lit(RASTER_W).alias("w"))


def tiles(spark, sf):
    return raster.tile_grid(rasters(spark, sf), F.lit(24), 4)


_GRID = """, ras AS (SELECT DISTINCT raster_id FROM pix),
grid AS (SELECT raster_id, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, 24 AS ts FROM ras, range(0, 9, {s}) a(ty), range(0, 25, {s}) b(tx))
"""


@register("tile_grid", _GRID.format(s=4) + "SELECT * FROM grid")
def tile_grid(spark, sf):
    return tiles(spark, sf)


@register(
    "tile_grid_multi",
    """, ras AS (SELECT DISTINCT raster_id FROM pix), sizes(ts) AS (VALUES (16), (24), (32))
SELECT raster_id, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, ts FROM ras, sizes, range(0, 32, 4) a(ty), range(0, 48, 4) b(tx) WHERE ty <= 32 - ts AND tx <= 48 - ts""",
)
def tile_grid_multi(spark, sf):
    return raster.tile_grids(rasters(spark, sf), [0.5, 0.75, 1.0], 4)


_TP = ", tp AS (SELECT grid.*, p.y - ty AS py, p.x - tx AS px, strength FROM grid JOIN pix p USING (raster_id) WHERE p.y >= ty AND p.y < ty + ts AND p.x >= tx AND p.x < tx + ts)\n"


@register(
    "tile_density_filter",
    _GRID.format(s=4) + _TP + "SELECT raster_id, ty, tx, ts, count(*) AS n, round(sum(strength), 4) + 0.0 AS weight FROM tp WHERE strength > 0.6 GROUP BY ALL HAVING count(*) >= 0.1 * 576",
)
def tile_density_filter(spark, sf):
    return raster.dense_tiles(pixels(spark, sf), tiles(spark, sf), 0.6, 0.1)


def grad_sql(kernel, source: str = "pix", h: int = RASTER_H, w: int = RASTER_W, mag: str = "sqrt(gx * gx + gy * gy)") -> str:
    cells = ", ".join(f"({dy}, {dx}, {kernel[dy + 1][dx + 1]}.0, {kernel[dx + 1][dy + 1]}.0)" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return f""", ker(dy, dx, kx, ky) AS (VALUES {cells}),
grad0 AS (SELECT raster_id, y - dy AS y, x - dx AS x, round(CAST(sum(strength * kx) AS DOUBLE), 9) + 0.0 AS gx, round(CAST(sum(strength * ky) AS DOUBLE), 9) + 0.0 AS gy FROM {source}, ker GROUP BY ALL),
grad AS MATERIALIZED (SELECT *, {mag} AS mag FROM grad0 WHERE y BETWEEN 0 AND {h - 1} AND x BETWEEN 0 AND {w - 1})
"""


@register("sobel_stencil", grad_sql(raster.SOBEL) + "SELECT raster_id, y, x, round(((abs(gx) + abs(gy)) / 2) ** 2, 4) + 0.0 AS value FROM grad")
def sobel_stencil(spark, sf):
    return raster.sobel_strength(pixels(spark, sf), RASTER_H, RASTER_W)


@register("scharr_stencil", grad_sql(raster.SCHARR) + "SELECT raster_id, y, x, round(mag / max(mag) OVER (PARTITION BY raster_id), 4) + 0.0 AS norm FROM grad")
def scharr_stencil(spark, sf):
    return raster.normalised_strength(raster.gradients(pixels(spark, sf), raster.SCHARR, RASTER_H, RASTER_W)).select(*raster.PIXEL, "norm")


#: The rows of ``grad`` that are the greatest along their gradient.
NMS = """, dir AS (SELECT *, round((degrees(atan2(gy, gx)) + 360) % 180, 9) AS a FROM grad),
k AS (SELECT *, CASE WHEN a >= 22.5 AND a < 67.5 THEN 1 WHEN a >= 67.5 AND a < 112.5 THEN 2 WHEN a >= 112.5 AND a < 157.5 THEN 3 ELSE 0 END AS s FROM dir),
st(s, dy, dx) AS (VALUES (0, 0, 1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (0, 0, -1), (1, -1, 1), (2, -1, 0), (3, -1, -1)),
far AS (SELECT raster_id, y - dy AS y, x - dx AS x, s, max(mag) AS far FROM grad, st GROUP BY ALL),
nms AS MATERIALIZED (SELECT k.raster_id, k.y, k.x, k.mag FROM k LEFT JOIN far USING (raster_id, y, x, s) WHERE round(k.mag, 9) >= round(coalesce(far, 0), 9))
"""


@register("nms", grad_sql(raster.SCHARR) + NMS + "SELECT raster_id, y, x, round(mag, 4) + 0.0 AS mag FROM nms")
def nms(spark, sf):
    return raster.thin(raster.gradients(pixels(spark, sf), raster.SCHARR, RASTER_H, RASTER_W), RASTER_H, RASTER_W).select(*raster.PIXEL, "mag")


@register(
    "cell_orientation_hist",
    grad_sql(raster.SCHARR)
    + """SELECT raster_id, CAST(y // 8 * 4 + x // 12 AS INTEGER) AS cell, CAST(least(floor(round((atan2(gy, gx) + pi()) / (2 * pi()), 9) * 8), 7) AS INTEGER) AS bin,
round(sum(mag), 4) + 0.0 AS value FROM grad GROUP BY ALL""",
)
def cell_orientation_hist(spark, sf):
    return raster.cell_histogram(raster.gradients(pixels(spark, sf), raster.SCHARR, RASTER_H, RASTER_W), RASTER_H, RASTER_W)


@register(
    "edge_descriptor",
    grad_sql(raster.SCHARR)
    + """, h AS (SELECT raster_id, CAST((y // 8 * 4 + x // 12) * 8 + least(floor(round((atan2(gy, gx) + pi()) / (2 * pi()), 9) * 8), 7) AS INTEGER) AS k, sum(mag) AS v FROM grad GROUP BY ALL),
f AS (SELECT r.raster_id, r.k, coalesce(v, 0.0) AS v FROM (SELECT raster_id, CAST(k AS INTEGER) AS k FROM (SELECT DISTINCT raster_id FROM h), range(0, 128) a(k)) r LEFT JOIN h USING (raster_id, k)),
n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY raster_id)) AS n FROM f)
SELECT raster_id, list(round(CASE WHEN n > 0 THEN v / n ELSE v END, 4) + 0.0 ORDER BY k) AS vec FROM n GROUP BY ALL""",
)
def edge_descriptor(spark, sf):
    found = raster.edge_descriptor(cell_orientation_hist(spark, sf))
    return found.withColumn("vec", F.transform("vec", lambda v: F.round(v, 4) + F.lit(0.0)))


@register(
    "outer_boundary",
    """, o(d) AS (VALUES (-1), (0), (1)), nb AS (SELECT raster_id, p.y + a.d AS y, p.x + b.d AS x, count(*) AS n FROM pix p, o a, o b WHERE a.d <> 0 OR b.d <> 0 GROUP BY ALL)
SELECT raster_id, y, x FROM nb ANTI JOIN pix USING (raster_id, y, x) WHERE y BETWEEN 1 AND 30 AND x BETWEEN 1 AND 46 AND n < 8""",
)
def outer_boundary(spark, sf):
    return raster.outer_boundary(pixels(spark, sf), RASTER_H, RASTER_W)


@register(
    "edt_nearest",
    """, bg AS (SELECT raster_id, y, x FROM (SELECT DISTINCT raster_id FROM pix), range(0, 32) a(y), range(0, 48) b(x)),
d AS (SELECT bg.raster_id, bg.y, bg.x, min((bg.y - p.y) ** 2 + (bg.x - p.x) ** 2) AS d FROM bg JOIN pix p ON bg.raster_id = p.raster_id GROUP BY ALL)
SELECT raster_id, y, x, round(sqrt(d), 4) + 0.0 AS d FROM d""",
)
def edt_nearest(spark, sf):
    cells = rasters(spark, sf).select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(RASTER_H - 1))).alias("y"))
    cells = cells.select("raster_id", F.col("y").cast("bigint").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(RASTER_W - 1).cast("bigint"))).alias("x"))
    return distance.nearest(cells, pixels(spark, sf), ["raster_id"])


#: Squared distances of all places of each tile to its nearest pixel.
_MAPS = (
    _GRID.format(s=4)
    + _TP.replace("tp AS", "tp AS MATERIALIZED")
    + """, dm AS MATERIALIZED (SELECT raster_id, ty, tx, gy, gx, min((gy - py) ** 2 + (gx - px) ** 2) AS d FROM tp, range(0, 24) a(gy), range(0, 24) b(gx) GROUP BY ALL)
"""
)
_SIDES = (
    _MAPS
    + """, ab AS (SELECT a.raster_id, a.ty, a.tx, strength AS w, sqrt(d) AS d FROM tp a JOIN dm b ON b.raster_id = a.raster_id + 1 AND b.ty = a.ty AND b.tx = a.tx AND gy = py AND gx = px),
ba AS (SELECT a.raster_id - 1 AS raster_id, a.ty, a.tx, strength AS w, sqrt(d) AS d FROM tp a JOIN dm b ON b.raster_id = a.raster_id - 1 AND b.ty = a.ty AND b.tx = a.tx AND gy = py AND gx = px)
"""
)


@register(
    "chamfer_tiles",
    _SIDES
    + """, f AS (SELECT raster_id, ty, tx, sum(w * d) / sum(w) AS d FROM ab GROUP BY ALL), g AS (SELECT raster_id, ty, tx, sum(w * d) / sum(w) AS d FROM ba GROUP BY ALL)
SELECT raster_id, ty, tx, round(round((f.d + g.d) / 2, 9), 4) + 0.0 AS cost FROM f JOIN g USING (raster_id, ty, tx)""",
)
def chamfer_tiles(spark, sf):
    found = distance.tiles_beside(pixels(spark, sf), RASTER_H, RASTER_W, 24, 4)
    return found.select("raster_id", "ty", "tx", F.round("cost", 9).alias("cost"))


@register(
    "hausdorff_tiles",
    _SIDES
    + """, f AS (SELECT raster_id, ty, tx, max(d) AS d FROM ab GROUP BY ALL), g AS (SELECT raster_id, ty, tx, max(d) AS d FROM ba GROUP BY ALL)
SELECT raster_id, ty, tx, round(greatest(f.d, g.d), 4) + 0.0 AS h FROM f JOIN g USING (raster_id, ty, tx)""",
)
def hausdorff_tiles(spark, sf):
    return distance.tiles_beside(pixels(spark, sf), RASTER_H, RASTER_W, 24, 4).select("raster_id", "ty", "tx", "h")


@register(
    "tile_hausdorff_sq",
    """, pt AS (SELECT DISTINCT drawing_id, x, y FROM (SELECT drawing_id, x1 AS x, y1 AS y FROM seg UNION ALL SELECT drawing_id, x2, y2 FROM seg) WHERE x >= 200 AND x < 328 AND y >= 100 AND y < 228),
ab AS (SELECT a.drawing_id, a.x, a.y, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pt a JOIN pt b ON b.drawing_id = a.drawing_id + 1 GROUP BY ALL),
ba AS (SELECT a.drawing_id - 1 AS drawing_id, a.x, a.y, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pt a JOIN pt b ON b.drawing_id = a.drawing_id - 1 GROUP BY ALL),
f AS (SELECT drawing_id, max(d) AS d FROM ab GROUP BY 1), g AS (SELECT drawing_id, max(d) AS d FROM ba GROUP BY 1)
SELECT drawing_id, round(greatest(f.d, g.d), 4) + 0.0 AS h FROM f JOIN g USING (drawing_id)""",
)
def tile_hausdorff_sq(spark, sf):
    from strokeframe.operators.geometry import points_in_tile

    from .fixtures import segments

    p = points_in_tile(segments(spark, sf), 100, 200, 128).select("drawing_id", F.col("px").alias("x"), F.col("py").alias("y")).distinct()
    h = distance.hausdorff(p, p.withColumn("drawing_id", F.col("drawing_id") - 1), ["drawing_id"], distance.nearest_point)
    return h.select("drawing_id", (F.col("h") * F.col("h")).alias("h"))


# -- tile pairs of neighbouring rasters ---------------------------------------


def pair_costs(spark, sf, pick="all"):
    """The tile pairs of each raster and the next: all, or those that are picked."""
    ids = rasters(spark, sf).select("raster_id")
    pairs = ids.select(F.col("raster_id").alias("i"), (F.col("raster_id") + 1).alias("j"))
    costs = distance.tile_pair_costs(pixels(spark, sf), tiles(spark, sf), pairs, 24, pick)
    return costs.withColumn("cost", F.round("cost", 9))


_COSTS = (
    _MAPS
    + """, f AS (SELECT a.raster_id AS i, b.raster_id AS j, a.ty AS yi, a.tx AS xi, b.ty AS yj, b.tx AS xj, sum(strength * sqrt(d)) / sum(strength) AS d FROM tp a JOIN dm b ON b.raster_id = a.raster_id + 1 AND gy = py AND gx = px GROUP BY ALL),
g AS (SELECT b.raster_id AS i, a.raster_id AS j, b.ty AS yi, b.tx AS xi, a.ty AS yj, a.tx AS xj, sum(strength * sqrt(d)) / sum(strength) AS d FROM tp a JOIN dm b ON b.raster_id = a.raster_id - 1 AND gy = py AND gx = px GROUP BY ALL),
tc AS (SELECT i, j, yi, xi, yj, xj, round((f.d + g.d) / 2, 9) AS cost FROM f JOIN g USING (i, j, yi, xi, yj, xj))
"""
)


@register("chamfer_all_pairs", _COSTS + "SELECT i, j, yi, xi, yj, xj, round(cost, 3) + 0.0 AS cost FROM tc", 3)
def chamfer_all_pairs(spark, sf):
    return pair_costs(spark, sf)


@register("best_tile_pair", _COSTS + "SELECT i, j, round(min(cost), 3) + 0.0 AS cost FROM tc GROUP BY ALL", 3)
def best_tile_pair(spark, sf):
    return pair_costs(spark, sf, "best").select("i", "j", "cost")


@register("ordered_tile_pair", digits=3)
def ordered_tile_pair(spark, sf):
    """Of each raster and the next, the pair of tiles that a scan in grid order with early exits ends at."""
    ids = rasters(spark, sf).select("raster_id")
    pairs = ids.select(F.col("raster_id").alias("i"), (F.col("raster_id") + 1).alias("j"))
    return distance.tile_pair_costs(pixels(spark, sf), tiles(spark, sf), pairs, 24, "first")


@register(
    "best_any_pos",
    _COSTS
    + """, b AS (SELECT i, j, min(ROW(round(cost, 9), yi, xi, yj, xj)) AS b FROM tc GROUP BY ALL),
c AS (SELECT i, j, round(b[1], 3) + 0.0 AS cost, b[2] AS yi, b[3] AS xi, b[4] AS yj, b[5] AS xj FROM b)
SELECT * FROM c UNION ALL SELECT j, i, cost, yj, xj, yi, xi FROM c""",
    3,
)
def best_any_pos(spark, sf):
    return search.either_way(pair_costs(spark, sf, "best"))


@register(
    "tile_positions",
    _GRID.format(s=4)
    + _TP
    + """, dense AS (SELECT raster_id, ty, tx, ts FROM tp WHERE strength > 0.6 GROUP BY ALL HAVING count(*) >= 0.17 * 576)
SELECT raster_id, ty, tx, CAST(ts AS INTEGER) AS ts FROM dense UNION ALL SELECT raster_id, 4, 12, 24 FROM ras ANTI JOIN dense USING (raster_id)""",
)
def tile_positions(spark, sf):
    return raster.tile_positions(pixels(spark, sf), rasters(spark, sf), 24, 4, 0.6, 0.17)


@register("best_arrival", _COSTS + "SELECT i, j, yi, xi, round(min(cost), 3) + 0.0 AS cost FROM tc GROUP BY ALL", 3)
def best_arrival(spark, sf):
    return pair_costs(spark, sf, "arrival").select("i", "j", "yi", "xi", "cost")


@register(
    "lookup_cost",
    _COSTS
    + """, asked AS (SELECT raster_id AS i, raster_id + 1 AS j, CASE WHEN raster_id % 3 > 0 THEN 0 END AS yi, CASE WHEN raster_id % 3 > 0 THEN 8 END AS xi, 8 AS yj, CASE WHEN raster_id % 3 = 1 THEN 8 ELSE 9 END AS xj FROM ras)
SELECT a.i, a.j, round(coalesce(CASE WHEN a.yi IS NULL THEN (SELECT min(cost) FROM tc WHERE tc.i = a.i AND tc.j = a.j) END, tc.cost, 100.0), 3) + 0.0 AS cost
FROM asked a LEFT JOIN tc ON a.i = tc.i AND a.j = tc.j AND a.yi = tc.yi AND a.xi = tc.xi AND a.yj = tc.yj AND a.xj = tc.xj""",
    3,
)
def lookup_cost(spark, sf):
    k = F.col("raster_id") % 3
    asked = rasters(spark, sf).select(
        F.col("raster_id").alias("i"), (F.col("raster_id") + 1).alias("j"), F.when(k > 0, 0).alias("yi"), F.when(k > 0, 8).alias("xi"), F.lit(8).alias("yj"), F.when(k == 1, 8).otherwise(9).alias("xj")
    )
    return search.lookup_cost(asked, pair_costs(spark, sf), F.lit(100.0)).select("i", "j", "cost")


# -- vectors ------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, {n} + 1), lambda k: a.vec[k + {o}] * b.vec[k + {o}]))"
_NORM = "sqrt(list_sum(list_transform({v}.vec[{lo}:{hi}], lambda x: x * x)))"


def _cos(o: int, n: int) -> str:
    norms = " / ".join(_NORM.format(v=v, lo=o + 1, hi=o + n) for v in "ab")
    return f"1 - {_DOT.format(n=n, o=o)} / {norms}"


def half(spark, sf, low: int):
    return descriptors(spark, sf).select("image_idx", F.slice("vec", low, 32).alias("vec"))


@register("cosine_matrix", f"SELECT a.image_idx AS i, b.image_idx AS j, round({_cos(0, 64)}, 4) + 0.0 AS d FROM vecs a JOIN vecs b ON a.image_idx < b.image_idx")
def cosine_matrix(spark, sf):
    return distance.cosine_distances(descriptors(spark, sf))


@register(
    "combined_distance",
    f""", p AS (SELECT a.image_idx AS i, b.image_idx AS j, {_cos(0, 32)} AS d, {_cos(32, 32)} AS e FROM vecs a JOIN vecs b ON a.image_idx < b.image_idx)
SELECT i, j, round(0.5 * d / (SELECT max(d) FROM p) + 0.5 * e / (SELECT max(e) FROM p), 4) + 0.0 AS d FROM p""",
)
def combined_distance(spark, sf):
    return distance.combined(distance.cosine_distances(half(spark, sf, 1)), distance.cosine_distances(half(spark, sf, 33)))


_KNN = f""", p AS (SELECT a.image_idx AS i, b.image_idx AS j, round({_cos(0, 64)}, 12) AS d FROM vecs a JOIN vecs b ON a.image_idx <> b.image_idx),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM p) WHERE rank <= 15)
"""


@register("knn", _KNN + "SELECT i, j, round(d, 4) + 0.0 AS d, CAST(rank AS INTEGER) AS rank FROM k")
def knn(spark, sf):
    return distance.knn(descriptors(spark, sf), 15)


@register("knn_hundredth", _KNN + "SELECT i, j, round(d, 4) + 0.0 AS d, CAST(rank AS INTEGER) AS rank FROM k WHERE i % 100 = 0")
def knn_hundredth(spark, sf):
    """The nearest of all vectors to every hundredth, exactly, in blocks."""
    vectors = descriptors(spark, sf)
    return inverted.exact(vectors, vectors.where("image_idx % 100 = 0"), 15)


@register("knn_index")
def knn_index(spark, sf):
    """The nearest found of all vectors to each, by an inverted file."""
    vectors = descriptors(spark, sf)
    return inverted.Index.build(vectors, 15).search(vectors, 15)


@register("knn_shortlist", _KNN + "SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM k")
def knn_shortlist(spark, sf):
    return distance.shortlist(distance.knn(descriptors(spark, sf), 15))


def shortlisted(spark, sf):
    near = distance.knn(descriptors(spark, sf), 15)
    return near.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d").groupBy("i", "j").agg(F.min("d").alias("cost"))


@register(
    "sparse_cost_fallback",
    _KNN
    + """, c AS (SELECT least(i, j) AS i, greatest(i, j) AS j, min(d) AS cost FROM k GROUP BY 1, 2), t AS (SELECT cost FROM c UNION ALL SELECT cost FROM c),
st AS (SELECT median(cost) AS mc, quantile_cont(cost, 0.9) AS p90 FROM t), co AS (SELECT i, j, d FROM p WHERE i < j), md AS (SELECT median(d) AS md FROM co WHERE d > 0)
SELECT co.i, co.j, round(coalesce(c.cost, d * (mc / (md + 1e-9)) + p90), 4) + 0.0 AS cost FROM co LEFT JOIN c ON co.i = c.i AND co.j = c.j, st, md""",
)
def sparse_cost_fallback(spark, sf):
    return distance.pair_fallback(shortlisted(spark, sf), distance.cosine_distances(descriptors(spark, sf)))


# -- paths --------------------------------------------------------------------


def collections(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("collection"), F.col("vec_id").alias("image_idx"))


def _within(spark, sf):
    """Costs of all pairs within a collection."""
    vectors = descriptors(spark, sf).join(collections(spark, sf), "image_idx")
    return distance.cosine_distances(vectors, within="collection").withColumnRenamed("d", "cost")


@register("greedy_path")
def greedy_path(spark, sf):
    return search.sequence(collections(spark, sf), _within(spark, sf), improve=False)


@register("two_opt_path")
def two_opt_path(spark, sf):
    return search.sequence(collections(spark, sf), _within(spark, sf))


@register(
    "path_cost",
    f""", m AS (SELECT label AS collection, vec_id AS image_idx, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS step FROM embeddings),
s AS (SELECT collection, image_idx, lead(image_idx) OVER (PARTITION BY collection ORDER BY step) AS nxt FROM m)
SELECT CAST(collection AS BIGINT) AS collection, round(sum({_cos(0, 64)}), 4) + 0.0 AS cost, CAST(0 AS BIGINT) AS missing FROM s JOIN vecs a ON a.image_idx = s.image_idx JOIN vecs b ON b.image_idx = s.nxt GROUP BY 1""",
)
def path_cost(spark, sf):
    from pyspark.sql import Window as W

    m = collections(spark, sf)
    in_order = m.withColumn("step", F.row_number().over(W.partitionBy("collection").orderBy("image_idx")))
    return search.path_cost(in_order, _within(spark, sf))


@register("settle_tiles")
def settle_tiles(spark, sf):
    """The rasters in order of their id, ten to a path, each with its best tile."""
    ids = rasters(spark, sf).select("raster_id")
    path = ids.select(F.expr("raster_id div 10").alias("collection"), F.col("raster_id").alias("step"), F.col("raster_id").alias("image_idx"))
    return search.settle_tiles(path, tiles(spark, sf), pair_costs(spark, sf))


@register(
    "tile_path_cost",
    _COSTS
    + """, path AS (SELECT raster_id // 10 AS collection, raster_id, CASE WHEN raster_id % 4 > 0 THEN raster_id % 3 * 4 END AS ty, raster_id % 7 * 4 AS tx FROM ras),
s AS (SELECT *, lead(raster_id) OVER w AS nxt, lead(ty) OVER w AS ny, lead(tx) OVER w AS nx FROM path WINDOW w AS (PARTITION BY collection ORDER BY raster_id)),
lo AS (SELECT i, j, min(cost) AS least FROM tc GROUP BY ALL)
SELECT s.collection, round(sum(coalesce(CASE WHEN s.ty IS NULL OR ny IS NULL THEN lo.least END, tc.cost, 100.0)), 3) + 0.0 AS cost FROM s LEFT JOIN lo ON lo.i = raster_id AND lo.j = nxt
LEFT JOIN tc ON tc.i = raster_id AND tc.j = nxt AND tc.yi = s.ty AND tc.xi = s.tx AND tc.yj = ny AND tc.xj = nx WHERE nxt IS NOT NULL GROUP BY 1""",
    3,
)
def tile_path_cost(spark, sf):
    """The rasters in order of their id, ten to a path, each at a tile of its own; every fourth has an open one."""
    k = F.col("raster_id")
    path = rasters(spark, sf).select(
        F.expr("raster_id div 10").alias("collection"), k.alias("step"), k.alias("image_idx"),
        F.when(k % 4 > 0, k % 3 * 4).cast("int").alias("ty"), (k % 7 * 4).cast("int").alias("tx"),
    )
    return search.tile_path_cost(path, pair_costs(spark, sf), F.lit(100.0))


def _drawn(spark, sf):
    """(collection, image_idx): the rasters, a hundred to a collection."""
    return rasters(spark, sf).select(F.expr("raster_id div 100").alias("collection"), F.col("raster_id").alias("image_idx"))


@register("tile_greedy_path")
def tile_greedy_path(spark, sf):
    return sequence.image_sequence(pixels(spark, sf), _drawn(spark, sf), RASTER_H, RASTER_W, 24, 4, improve=False, settle=False)


@register("tile_two_opt_path")
def tile_two_opt_path(spark, sf):
    return sequence.image_sequence(pixels(spark, sf), _drawn(spark, sf), RASTER_H, RASTER_W, 24, 4, settle=False)


@register("sequence_pipeline")
def sequence_pipeline(spark, sf):
    """From raw pixels to a path through each collection, its tiles and the crops of photos of four times the size."""
    edges = raster.large_components(raster.edges(raw_pixels(spark, sf), 0.5), RASTER_H, RASTER_W, 3)
    found = sequence.image_sequence(edges, _drawn(spark, sf), RASTER_H, RASTER_W, 24, 4)
    frames = found.select("*", *[F.lit(v).alias(n) for n, v in (("h", 4 * RASTER_H), ("w", 4 * RASTER_W), ("ld_h", RASTER_H), ("ld_w", RASTER_W), ("ts", 24))])
    return search.crop_plan(frames).select("collection", "step", "image_idx", "ty", "tx", "total", "cy", "cx", "ch", "cw")


@register(
    "frame_side",
    """, f AS (SELECT 600 + raster_id % 7 * 100 AS h, 900 + raster_id % 5 * 100 AS w FROM (SELECT DISTINCT raster_id FROM pix)), s AS (SELECT *, least(h, w) / 32.0 AS s FROM f)
SELECT CAST(min(least(floor(round(24 * s, 9)), h, w)) AS INTEGER) AS side FROM s""",
)
def frame_side(spark, sf):
    return search.frame_side(crop_plan(spark, sf))


@register(
    "crop_plan",
    """, f AS (SELECT raster_id, 600 + raster_id % 7 * 100 AS h, 900 + raster_id % 5 * 100 AS w, 32 AS ld_h, 48 AS ld_w, 4 AS ty, 12 AS tx, 24 AS ts FROM (SELECT DISTINCT raster_id FROM pix)),
s AS (SELECT *, least(h, w) / least(ld_h, ld_w) AS s FROM f), c AS (SELECT *, least(floor(round(ts * s, 9)), h) AS ch, least(floor(round(ts * s, 9)), w) AS cw FROM s)
SELECT raster_id, CAST(greatest(least(floor(round(ty * s, 9)), h - ch), 0) AS INTEGER) AS cy, CAST(greatest(least(floor(round(tx * s, 9)), w - cw), 0) AS INTEGER) AS cx, CAST(ch AS INTEGER) AS ch, CAST(cw AS INTEGER) AS cw FROM c""",
)
def crop_plan(spark, sf):
    k = F.col("raster_id")
    frames = rasters(spark, sf).select("raster_id", (600 + k % 7 * 100).cast("int").alias("h"), (900 + k % 5 * 100).cast("int").alias("w"), *[F.lit(v).alias(n) for n, v in (("ld_h", 32), ("ld_w", 48), ("ty", 4), ("tx", 12), ("ts", 24))])
    return search.crop_plan(frames).select("raster_id", "cy", "cx", "ch", "cw")


# -- pixels -------------------------------------------------------------------


def colours(spark, sf):
    q = F.round(F.col("strength") * 50).cast("int")
    rgb = [((F.col("y") * a + F.col("x") * b + q * c) % 256).cast("double") for a, b, c in ((5, 3, 2), (7, 11, 1), (2, 13, 4))]
    return raw_pixels(spark, sf).select(*raster.PIXEL, *[v.alias(n) for v, n in zip(rgb, "rgb", strict=True)])


COLOURS = """, col AS (SELECT raster_id, y, x, CAST((y * 5 + x * 3 + CAST(strength * 50 AS INT) * 2) % 256 AS DOUBLE) AS r, CAST((y * 7 + x * 11 + CAST(strength * 50 AS INT)) % 256 AS DOUBLE) AS g,
  CAST((y * 2 + x * 13 + CAST(strength * 50 AS INT) * 4) % 256 AS DOUBLE) AS b FROM raw_pix)
"""


@register(
    "saliency_mask",
    COLOURS
    + """, a AS (SELECT *, sqrt((r - avg(r) OVER w) ** 2 + (g - avg(g) OVER w) ** 2 + (b - avg(b) OVER w) ** 2) AS away FROM col WINDOW w AS (PARTITION BY raster_id)),
s AS (SELECT *, round(0.5 * exp(-((x - 24.0) ** 2 + (y - 16.0) ** 2) / (2 * (32 / 3.0) * (32 / 3.0))) + 0.5 * away / max(away) OVER (PARTITION BY raster_id), 9) AS s FROM a),
c AS (SELECT raster_id, round(quantile_cont(s, 0.6), 9) AS cut FROM s GROUP BY 1) SELECT raster_id, y, x, CASE WHEN s > cut THEN 255 ELSE 0 END AS mask FROM s JOIN c USING (raster_id)""",
)
def saliency_mask(spark, sf):
    return raster.saliency(colours(spark, sf), RASTER_H, RASTER_W).select(*raster.PIXEL, "mask")


@register("binary_mask", COLOURS + "SELECT raster_id, y, x, CASE WHEN (r + g + b) / 3 > 128 THEN 255 ELSE 0 END AS mask FROM col")
def binary_mask(spark, sf):
    return raster.figure_mask(colours(spark, sf)).select(*raster.PIXEL, "mask")


_LAYERS = ", ".join(
    [f"CASE WHEN fig THEN {c}::DOUBLE ELSE 0.0 END AS figure_{c}, CASE WHEN fig THEN 0.0 ELSE {c}::DOUBLE END AS ground_{c}, CASE WHEN fig THEN trunc(0.5 * {c} + 127.5) ELSE {c}::DOUBLE END AS overlay_{c}" for c in "rgb"]
)


@register(
    "figure_ground",
    COLOURS
    + f""", m AS (SELECT *, (r + g + b) / 3 > 128 AS fig FROM col)
SELECT raster_id, y, x, {_LAYERS}, CASE WHEN fig THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS figure_a, CASE WHEN fig THEN 0.0::DOUBLE ELSE 255.0::DOUBLE END AS ground_a, 255.0::DOUBLE AS overlay_a FROM m""",
)
def figure_ground(spark, sf):
    return raster.figure_ground(raster.figure_mask(colours(spark, sf)))


#: Means and deviations of the channels of natural photographs, as pretrained networks expect them.
MEANS, DEVIATIONS = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]


@register(
    "normalised_channels",
    COLOURS + "SELECT raster_id, y, x, " + ", ".join(f"round(({c} / 255.0 - {m}) / {v}, 4) + 0.0 AS {c}" for c, m, v in zip("rgb", MEANS, DEVIATIONS, strict=True)) + " FROM col",
)
def normalised_channels(spark, sf):
    return raster.normalised_channels(colours(spark, sf), MEANS, DEVIATIONS)


@register("edge_threshold", "SELECT raster_id, y, x, strength FROM raw_pix WHERE strength >= 0.6")
def edge_threshold(spark, sf):
    return raster.edges(raw_pixels(spark, sf), 0.6)


#: Every pixel that is the least of those about it spreads over what touches; the least that reaches a pixel is its label.
_COMPONENTS = """, o(d) AS (VALUES (-1), (0), (1)), ip AS MATERIALIZED (SELECT raster_id, y, x, strength, y * 48 + x AS id FROM pix),
touch AS MATERIALIZED (SELECT p.raster_id, p.id, q.id AS beside FROM ip p CROSS JOIN o a CROSS JOIN o b JOIN ip q ON q.raster_id = p.raster_id AND q.y = p.y + a.d AND q.x = p.x + b.d),
reach AS (SELECT raster_id, id AS root, id FROM touch GROUP BY ALL HAVING min(beside) = id
  UNION SELECT r.raster_id, r.root, t.beside FROM reach r JOIN touch t ON t.raster_id = r.raster_id AND t.id = r.id),
labelled AS MATERIALIZED (SELECT ip.raster_id, y, x, strength, min(root) AS label FROM ip JOIN reach USING (raster_id, id) GROUP BY ALL)
"""


@register("components")
def components(spark, sf):
    return raster.components(pixels(spark, sf), RASTER_H, RASTER_W)


@register("large_components")
def large_components(spark, sf):
    return raster.large_components(pixels(spark, sf), RASTER_H, RASTER_W, 8)


_RECURSIVE = SQL.replace("WITH points", "WITH RECURSIVE points", 1) + _COMPONENTS
ORACLE["components"] = _RECURSIVE + "SELECT raster_id, y, x, round(strength, 4) + 0.0 AS strength, CAST(label AS BIGINT) AS label FROM labelled"
ORACLE["large_components"] = _RECURSIVE + "SELECT raster_id, y, x, round(strength, 4) + 0.0 AS strength FROM labelled SEMI JOIN (SELECT raster_id, label FROM labelled GROUP BY ALL HAVING count(*) >= 8) USING (raster_id, label)"


@register(
    "raster_line",
    """, l AS (SELECT drawing_id, CAST(trunc(x1) AS INT) AS a, CAST(trunc(y1) AS INT) AS b, CAST(trunc(x2) AS INT) AS c, CAST(trunc(y2) AS INT) AS d FROM seg),
n AS (SELECT *, greatest(abs(c - a), abs(d - b)) AS n FROM l), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n),
p AS (SELECT DISTINCT drawing_id, CAST(floor(b + (d - b) * k / greatest(n, 1) + 0.5) AS BIGINT) AS y, CAST(floor(a + (c - a) * k / greatest(n, 1) + 0.5) AS BIGINT) AS x FROM k)
SELECT drawing_id, y, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(x * x) AS BIGINT) AS sxx FROM p GROUP BY ALL""",
)
def raster_line(spark, sf):
    """The pixels of all segments, told by row: their number, and the sums of x and of its square."""
    return raster.painted_rows(segments(spark, sf, dealt=True), sizes=sizes(spark, sf))


@register("edge_stats", "SELECT raster_id, round(count(*) / 1536.0, 4) + 0.0 AS share, round(max(strength), 4) + 0.0 AS top, round(avg(strength), 4) + 0.0 AS mean FROM pix WHERE strength > 0 GROUP BY 1")
def edge_stats(spark, sf):
    from strokeframe.operators.stats import strength_summary

    return strength_summary(pixels(spark, sf), RASTER_H, RASTER_W)
