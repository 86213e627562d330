"""Queries over colours, tiles held against whole images, and medial axes, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strokeframe.operators import distance, medial, photo, raster, scan, sequence, skeleton, stats

from . import line_queries
from .fixtures import HEIGHT, RASTER_H, RASTER_W, SQL, WIDTH, branches, pixels, raw_pixels, segments
from .raster_queries import COLOURS, NMS, colours, grad_sql, rasters

QUERIES: dict[str, line_queries.Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, digits: int = 4):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: line_queries.rounded(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLE[name] = SQL + sql
        return f

    return keep


def _in_steps(value: str) -> str:
    """Nine decimals and then four, both times as a decimal: what lies halfway is rounded up, as in Spark."""
    return f"CAST(CAST(CAST(round({value}, 9) AS DECIMAL(18, 9)) AS DECIMAL(18, 4)) AS DOUBLE) + 0.0"


# -- from colours to edges ----------------------------------------------------

_GREY = COLOURS + ", gry AS (SELECT raster_id, y, x, (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255 AS strength FROM col)\n"
_RESIZED = (
    _GREY
    + """, sml AS MATERIALIZED (SELECT raster_id, ty AS y, tx AS x,
  sum(strength * (least((y + 1) * 24, (ty + 1) * 32) - greatest(y * 24, ty * 32)) / 32.0 * (least((x + 1) * 36, (tx + 1) * 48) - greatest(x * 36, tx * 48)) / 48.0) AS strength
  FROM gry, range(0, 24) a(ty), range(0, 36) b(tx) WHERE ty * 32 < (y + 1) * 24 AND (ty + 1) * 32 > y * 24 AND tx * 48 < (x + 1) * 36 AND (tx + 1) * 48 > x * 36 GROUP BY ALL)
"""
)


def _blur(source: str, h: int, w: int) -> str:
    cells = ", ".join(f"({dy}, {dx}, {photo.BINOMIAL[dy + 1][dx + 1] / 16}::DOUBLE)" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return f""", bk(dy, dx, k) AS (VALUES {cells}),
blr AS MATERIALIZED (SELECT * FROM (SELECT raster_id, y - dy AS y, x - dx AS x, round(sum(strength * k), 9) AS strength FROM {source}, bk GROUP BY ALL) WHERE y BETWEEN 0 AND {h - 1} AND x BETWEEN 0 AND {w - 1})
"""


@register("grey", _GREY + "SELECT raster_id, y, x, round(strength, 4) + 0.0 AS strength FROM gry")
def grey(spark, sf):
    return photo.grey(colours(spark, sf))


@register("resized", _RESIZED + f"SELECT raster_id, y, x, {_in_steps('strength')} AS strength FROM sml")
def resized(spark, sf):
    return photo.resized(photo.grey(colours(spark, sf)), RASTER_H, RASTER_W, 24, 36).withColumn("strength", F.round("strength", 9))


@register("blurred", _GREY + _blur("gry", 32, 48) + f"SELECT raster_id, y, x, {_in_steps('strength')} AS strength FROM blr")
def blurred(spark, sf):
    return photo.blurred(photo.grey(colours(spark, sf)), RASTER_H, RASTER_W)


_SCHARR = _RESIZED + _blur("sml", 24, 36) + grad_sql(raster.SCHARR, "blr", 24, 36)


@register("scharr_photo", _SCHARR + f"SELECT raster_id, y, x, {_in_steps('mag / max(mag) OVER (PARTITION BY raster_id)')} AS strength FROM grad")
def scharr_photo(spark, sf):
    return photo.scharr_edges(colours(spark, sf), RASTER_H, RASTER_W, 24, suppress=False)[0]


@register(
    "photo_edges",
    _SCHARR
    + NMS
    + """, nrm AS (SELECT raster_id, y, x, round(mag / max(mag) OVER (PARTITION BY raster_id), 9) AS s FROM nms),
low AS MATERIALIZED (SELECT * FROM nrm WHERE s >= 0.6), o(d) AS (VALUES (-1), (0), (1)),
kept AS (SELECT * FROM low l WHERE EXISTS (SELECT 1 FROM low n WHERE n.raster_id = l.raster_id AND abs(n.y - l.y) <= 1 AND abs(n.x - l.x) <= 1 AND (n.y <> l.y OR n.x <> l.x)))
SELECT raster_id, y, x, round(pow(s / max(s) OVER (PARTITION BY raster_id), 1.5), 4) + 0.0 AS strength FROM kept""",
)
def photo_edges(spark, sf):
    """The whole way from colours to cleaned edges; components have two pixels at least."""
    found, h, w = photo.scharr_edges(colours(spark, sf), RASTER_H, RASTER_W, 24)
    return photo.cleaned_edges(found, h, w, least=2)


@register(
    "sobel_photo",
    _GREY + _blur("gry", 32, 48) + grad_sql(raster.SOBEL, "blr") + "SELECT raster_id, y, x, round(((least(abs(gx), 1.0) + least(abs(gy), 1.0)) / 2) ** 2, 4) + 0.0 AS value FROM grad",
)
def sobel_photo(spark, sf):
    return photo.sobel_edges(colours(spark, sf), RASTER_H, RASTER_W)


@register("canny_edges")
def canny_edges(spark, sf):
    """Edges over 200 that are linked with one over 300."""
    bright = photo.grey(colours(spark, sf)).withColumn("strength", F.col("strength") * 255)
    return photo.canny_edges(bright, RASTER_H, RASTER_W, 200, 300)


ORACLE["canny_edges"] = (
    (SQL + _GREY).replace("WITH points", "WITH RECURSIVE points", 1)
    + ", g255 AS (SELECT raster_id, y, x, strength * 255 AS strength FROM gry)\n"
    + grad_sql(raster.SOBEL, "g255", mag="abs(gx) + abs(gy)")
    + NMS.rstrip()
    + """, weak AS MATERIALIZED (SELECT raster_id, y, x, mag FROM nms WHERE mag > 200), o(d) AS (VALUES (-1), (0), (1)),
held AS (SELECT raster_id, y, x FROM weak WHERE mag > 300 UNION SELECT w.raster_id, w.y, w.x FROM held h, o a, o b, weak w WHERE w.raster_id = h.raster_id AND w.y = h.y + a.d AND w.x = h.x + b.d)
SELECT * FROM held"""
)


def _shares(n: int, to: int) -> str:
    return ", ".join(f"({t}, {k}, {v!r}::DOUBLE)" for t, row in enumerate(photo.sinc_weights(n, to).tolist()) for k, v in enumerate(row) if v)


@register(
    "resampled",
    COLOURS
    + f""", vy(t, k, g) AS (VALUES {_shares(RASTER_H, 20)}), vx(t, k, g) AS (VALUES {_shares(RASTER_W, 60)}),
sd AS MATERIALIZED (SELECT raster_id, t AS y, x, sum(r * vy.g) AS r, sum(col.g * vy.g) AS g, sum(b * vy.g) AS b FROM (SELECT raster_id, y, x, r, g, b FROM col) col JOIN vy ON k = y GROUP BY ALL),
sx AS (SELECT raster_id, y, t AS x, sum(r * vx.g) AS r, sum(sd.g * vx.g) AS g, sum(b * vx.g) AS b FROM sd JOIN vx ON k = x GROUP BY ALL)
SELECT p.raster_id, CAST(a.y AS BIGINT) AS y, CAST(c.x AS BIGINT) AS x, round(coalesce(r, 0), 4) + 0.0 AS r, round(coalesce(g, 0), 4) + 0.0 AS g, round(coalesce(b, 0), 4) + 0.0 AS b
FROM (SELECT DISTINCT raster_id FROM pix) p, range(0, 20) a(y), range(0, 60) c(x) LEFT JOIN sx ON sx.raster_id = p.raster_id AND sx.y = a.y AND sx.x = c.x""",
)
def resampled(spark, sf):
    """Photographs brought from 32 x 48 to 20 x 60."""
    return photo.resampled(colours(spark, sf).join(rasters(spark, sf).select("raster_id"), "raster_id"), rasters(spark, sf), ["r", "g", "b"], 20, 60)


# -- tiles held against whole images ------------------------------------------


@register(
    "hausdorff_v1",
    """, ras AS (SELECT DISTINCT raster_id FROM pix),
dm AS MATERIALIZED (SELECT r.raster_id, gy, gx, min((gy - y) ** 2 + (gx - x) ** 2) AS d FROM ras r JOIN pix p ON p.raster_id = r.raster_id, range(0, 32) a(gy), range(0, 48) b(gx) GROUP BY ALL),
cand AS (SELECT raster_id AS i, raster_id + 1 AS j, yj, xj FROM ras, range(0, 8, 4) a(yj), range(0, 24, 4) b(xj) WHERE raster_id + 1 IN (SELECT raster_id FROM ras)),
ab AS (SELECT i, j, yj, xj, max(d) AS d FROM cand JOIN pix p ON p.raster_id = i AND y BETWEEN 4 AND 27 AND x BETWEEN 12 AND 35 JOIN dm ON dm.raster_id = j AND gy = y - 4 + yj AND gx = x - 12 + xj GROUP BY ALL),
ba AS (SELECT i, j, yj, xj, max(d) AS d FROM cand JOIN pix p ON p.raster_id = j AND y >= yj AND y < yj + 24 AND x >= xj AND x < xj + 24 JOIN dm ON dm.raster_id = i AND gy = y - yj + 4 AND gx = x - xj + 12 GROUP BY ALL)
SELECT i, 4 AS yi, 12 AS xi, j, CAST(yj AS INTEGER) AS yj, CAST(xj AS INTEGER) AS xj, round(sqrt(greatest(coalesce(ab.d, 0), ba.d)), 4) + 0.0 AS cost FROM ba LEFT JOIN ab USING (i, j, yj, xj)""",
)
def hausdorff_v1(spark, sf):
    """A tile of each raster against all tiles of the next."""
    ids = rasters(spark, sf).select("raster_id")
    asked = ids.select(F.col("raster_id").alias("i"), F.lit(4).alias("yi"), F.lit(12).alias("xi"), (F.col("raster_id") + 1).alias("j"))
    return scan.scan_costs(pixels(spark, sf), asked, RASTER_H, RASTER_W, 24, 4)


def _collections(spark, sf, size: int):
    return rasters(spark, sf).select((F.expr("raster_id") / size).cast("bigint").alias("collection"), F.col("raster_id").alias("image_idx"))


@register("scan_chain")
def scan_chain(spark, sf):
    """The rasters, twenty to a chain."""
    return scan.scan_chain(pixels(spark, sf), _collections(spark, sf, 20), RASTER_H, RASTER_W, 24, 4, (4, 12))


@register("refined_tiles")
def refined_tiles(spark, sf):
    """The rasters in order of their id, ten to a path, from their middle tile on."""
    path = _collections(spark, sf, 10).select("collection", F.col("image_idx").alias("step"), "image_idx", *[F.lit(v).alias(n) for n, v in (("ty", 4), ("tx", 12), ("ts", 24))])
    return scan.refined_tiles(path, pixels(spark, sf), RASTER_H, RASTER_W, [0.5, 0.75, 1.0], 2, 4)


@register("photo_sequence")
def photo_sequence(spark, sf):
    """From the colours of all rasters to sequences of ten, with tiles of two sizes placed finely."""
    return sequence.photo_sequence(colours(spark, sf), _collections(spark, sf, 10), RASTER_H, RASTER_W, [0.5, 0.75], 6, 4, RASTER_H, 0.2, 3, 2, 4)


# -- medial axes --------------------------------------------------------------

_FIELD = """, ras AS (SELECT DISTINCT raster_id FROM pix), cell AS (SELECT raster_id, y, x FROM ras, range(0, 32) a(y), range(0, 48) b(x)),
o(d) AS (VALUES (-1), (0), (1)), nb AS (SELECT raster_id, p.y + a.d AS y, p.x + b.d AS x, count(*) AS n FROM pix p, o a, o b WHERE a.d <> 0 OR b.d <> 0 GROUP BY ALL),
bnd AS (SELECT raster_id, y, x FROM nb ANTI JOIN pix USING (raster_id, y, x) WHERE y BETWEEN 1 AND 30 AND x BETWEEN 1 AND 46 AND n < 8),
back AS MATERIALIZED (SELECT * FROM cell ANTI JOIN pix USING (raster_id, y, x)), shape AS MATERIALIZED (SELECT raster_id, y, x FROM pix UNION ALL SELECT * FROM bnd),
near AS (SELECT p.raster_id, p.y, p.x, 1 AS side, min(((p.y - b.y) * (p.y - b.y) + (p.x - b.x) * (p.x - b.x)) * 1536 + b.y * 48 + b.x) AS m FROM pix p JOIN back b ON b.raster_id = p.raster_id GROUP BY ALL
  UNION ALL SELECT p.raster_id, p.y, p.x, -1 AS side, min(((p.y - b.y) * (p.y - b.y) + (p.x - b.x) * (p.x - b.x)) * 1536 + b.y * 48 + b.x) AS m FROM back p JOIN shape b ON b.raster_id = p.raster_id GROUP BY ALL),
field AS MATERIALIZED (SELECT raster_id, y, x, side * sqrt(m // 1536) AS d, m % 1536 // 48 AS ny, m % 48 AS nx FROM near)
"""


@register("edt_index", _FIELD + "SELECT raster_id, y, x, round(abs(d), 4) + 0.0 AS d, ny, nx FROM field WHERE d > 0")
def edt_index(spark, sf):
    """Each pixel with the nearest place that has none."""
    shape = pixels(spark, sf).select(*raster.PIXEL)
    return distance.nearest_pixel(shape, medial.background(shape, RASTER_H, RASTER_W), ["raster_id"])


@register("boundary_field", _FIELD + "SELECT raster_id, y, x, round(d, 4) + 0.0 AS d, ny, nx FROM field")
def boundary_field(spark, sf):
    return medial.boundary_field(pixels(spark, sf), RASTER_H, RASTER_W)


_FLUX = (
    _FIELD
    + ", smp(sy, sx, oy, ox) AS (VALUES "
    + ", ".join(f"({sy!r}::DOUBLE, {sx!r}::DOUBLE, {oy}, {ox})" for sy, sx, oy, ox in medial.circle())
    + """),
vec AS (SELECT p.raster_id, p.y, p.x, p.d, sy, sx, q.ny - q.y + oy - sy AS vy, q.nx - q.x + ox - sx AS vx FROM field p, smp JOIN field q ON q.raster_id = p.raster_id AND q.y = p.y + oy AND q.x = p.x + ox
  WHERE p.d > -1.5 AND p.y BETWEEN 1 AND 30 AND p.x BETWEEN 1 AND 46),
flux AS MATERIALIZED (SELECT raster_id, y, x, d, round(sum(CASE WHEN vy * vy + vx * vx > 1e-18 THEN (vy * sy + vx * sx) / sqrt(vy * vy + vx * vx) ELSE 0.0 END), 9) AS flux FROM vec GROUP BY ALL)
"""
)


@register("outward_flux", _FLUX + "SELECT raster_id, y, x, round(d, 4) + 0.0 AS d, round(flux, 4) + 0.0 AS flux FROM flux")
def outward_flux(spark, sf):
    return medial.outward_flux(boundary_field(spark, sf), RASTER_H, RASTER_W)


@register(
    "medial_axis",
    _FLUX
    + """, m AS MATERIALIZED (SELECT * FROM flux WHERE flux > 60 * 2 / pi() * sin(radians(28)))
SELECT raster_id, y, x, round(d, 4) + 0.0 AS r, round(flux, 4) + 0.0 AS flux FROM m WHERE EXISTS (SELECT 1 FROM m n WHERE n.raster_id = m.raster_id AND abs(n.y - m.y) <= 1 AND abs(n.x - m.x) <= 1 AND (n.y <> m.y OR n.x <> m.x))""",
)
def medial_axis(spark, sf):
    return medial.medial_axis(pixels(spark, sf), RASTER_H, RASTER_W, least=2)


# -- thin lines, branches, borders --------------------------------------------

_AROUND = """, offs(k, dy, dx) AS (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)),
ip AS MATERIALIZED (SELECT CAST(raster_id AS BIGINT) AS r, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM pix),
around AS MATERIALIZED (SELECT p.r, p.y, p.x, CAST(sum(CASE WHEN q.r IS NULL THEN 0 ELSE 1 << k END) AS BIGINT) AS m
  FROM ip p CROSS JOIN offs LEFT JOIN ip q ON q.r = p.r AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL)"""
#: A walk goes on while it meets no lower number than it began with: only a ring's lowest comes back to itself.
_WALK = """, walk AS (SELECT r, id AS start, id AS cur, 0 AS k, {free} AS free FROM link l
  UNION ALL SELECT w.r, w.start, l.nxt, w.k + 1, w.free FROM walk w JOIN link l ON l.r = w.r AND l.id = w.cur WHERE l.nxt IS NOT NULL AND (w.free OR l.nxt > w.start)),
ring AS (SELECT w.r, w.start FROM walk w JOIN link l ON l.r = w.r AND l.id = w.cur WHERE NOT w.free AND l.nxt = w.start)"""


def _step(dy: str, dx: str) -> str:
    return f"((({dy}) + 1) * 3 + ({dx}) + 1 - CASE WHEN (({dy}) + 1) * 3 + ({dx}) + 1 > 4 THEN 1 ELSE 0 END)"


def _recursive(sql: str) -> str:
    return SQL.replace("WITH points", "WITH RECURSIVE points", 1) + sql


@register("borders")
def borders(spark, sf):
    return skeleton.borders(pixels(spark, sf), RASTER_H, RASTER_W)


ORACLE["borders"] = _recursive(
    _AROUND
    + f""", sides(s, oy, ox, fy, fx) AS (VALUES (0, -1, 0, 0, 1), (1, 0, 1, 1, 0), (2, 1, 0, 0, -1), (3, 0, -1, -1, 0)),
link AS MATERIALIZED (SELECT r, (y * 50 + x) * 4 + s AS id,
  CASE WHEN (m >> {_step("oy + fy", "ox + fx")}) & 1 = 1 THEN ((y + oy + fy) * 50 + x + ox + fx) * 4 + (s + 3) % 4
    WHEN (m >> {_step("fy", "fx")}) & 1 = 1 THEN ((y + fy) * 50 + x + fx) * 4 + s ELSE (y * 50 + x) * 4 + (s + 1) % 4 END AS nxt
  FROM around, sides WHERE (m >> {_step("oy", "ox")}) & 1 = 0)"""
    + _WALK.format(free="false")
    + """
SELECT w.r AS raster_id, w.start AS border, w.k AS pt, w.cur // 4 // 50 AS y, w.cur // 4 % 50 AS x, w.start % 4 <> 0 AS hole FROM walk w JOIN ring USING (r, start)"""
)


@register("trace_lines")
def trace_lines(spark, sf):
    """The branches of all edge pixels."""
    return skeleton.trace(pixels(spark, sf), RASTER_H, RASTER_W)


ORACLE["trace_lines"] = _recursive(
    _AROUND
    + f""", slim AS MATERIALIZED (SELECT r, y, x, sum(CASE WHEN (m >> k) & 1 = 1 AND (dy = 0 OR dx = 0 OR ((m >> {_step("dy", "0")}) & 1 = 0 AND (m >> {_step("0", "dx")}) & 1 = 0)) THEN 1 << k ELSE 0 END)::BIGINT AS m
  FROM around, offs GROUP BY ALL),
tail AS (SELECT r, y, x, k, (y * 50 + x) * 8 + k AS id, y + dy AS hy, x + dx AS hx, bit_count(m) AS n FROM slim, offs WHERE (m >> k) & 1 = 1),
link AS MATERIALIZED (SELECT t.r, t.id, t.n, CASE WHEN bit_count(h.m) = 2 THEN (h.y * 50 + h.x) * 8 + bit_count((h.m - (1 << (7 - t.k))) - 1) END AS nxt,
  (t.hy * 50 + t.hx) * 8 + 7 - t.k AS back, t.hy * 50 + t.hx AS head FROM tail t JOIN slim h ON h.r = t.r AND h.y = t.hy AND h.x = t.hx)"""
    + _WALK.format(free="l.n <> 2")
    + """
, done AS (SELECT w.r, w.start, w.k, l.head, l.back FROM walk w JOIN link l ON l.r = w.r AND l.id = w.cur WHERE w.free AND l.nxt IS NULL),
kept AS (SELECT * FROM done WHERE start < back),
other AS (SELECT a.r, a.start, b.start AS twin FROM ring a JOIN link l ON l.r = a.r AND l.id = a.start JOIN walk w ON w.r = l.r AND w.cur = l.back JOIN ring b ON b.r = w.r AND b.start = w.start)
SELECT w.r AS raster_id, w.start AS branch, w.k AS pt, w.cur // 8 // 50 AS y, w.cur // 8 % 50 AS x FROM walk w JOIN kept USING (r, start)
UNION ALL SELECT r, start, k + 1, head // 50, head % 50 FROM kept
UNION ALL SELECT w.r, w.start, w.k, w.cur // 8 // 50, w.cur // 8 % 50 FROM walk w JOIN other USING (r, start) WHERE start < twin
UNION ALL SELECT r, (y * 50 + x) * 8, 0, y, x FROM slim WHERE m = 0"""
)


@register("vectorize_contours")
def vectorize_contours(spark, sf):
    """The borders of all raw pixels of a tenth of full strength or more, as polylines."""
    return skeleton.vectorize(raw_pixels(spark, sf), RASTER_H, RASTER_W)


@register("skeleton_axis")
def skeleton_axis(spark, sf):
    """The medial axes thinned to one pixel."""
    return medial.skeleton_axis(pixels(spark, sf), RASTER_H, RASTER_W, least=2)


@register("axis_branches")
def axis_branches(spark, sf):
    """The branches of the thinned medial axes, with their parallelism."""
    points = skeleton.branch_points(skeleton_axis(spark, sf), RASTER_H, RASTER_W)
    return medial.branch_score(points, "parallelism").select("drawing_id", "contour_id", "pt", "x", "y", "r", "parallelism")


def _tangents(spark, sf):
    scored = medial.separation(medial.branch_derivatives(branches(spark, sf)))
    return medial.tangent_points(scored.withColumn("score", F.col("separation")))


_TANGENTS = """, nx AS (SELECT drawing_id, contour_id, pt, x, y, r, 1 - 1 / CASE WHEN rs <> 0 THEN rs END AS score, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(r) OVER w AS r2 FROM deriv WINDOW w AS (PARTITION BY contour_id ORDER BY pt)),
j(j) AS (VALUES (-0.1::DOUBLE), (0.0::DOUBLE), (0.1::DOUBLE)), side(side) AS (VALUES (1), (-1)),
tg0 AS (SELECT n.*, (r + a.j + r2 + b.j) / 2 AS mr, (x - x2) / 2 AS vx, (y - y2) / 2 AS vy, sqrt((x - x2) ** 2 + (y - y2) ** 2) AS d, a.j AS ja, b.j AS jb, side FROM nx n, j a, j b, side WHERE x2 IS NOT NULL),
tg1 AS (SELECT *, CASE WHEN d > 0 THEN greatest(least(((r2 + jb) - (r + ja)) / d, 1.0), -1.0) END AS co FROM tg0),
tg2 AS (SELECT *, side * sqrt(1 - co * co) AS si FROM tg1),
tg AS MATERIALIZED (SELECT drawing_id, contour_id, score, CASE WHEN d > 0 THEN (x + x2) / 2 + (co * vx + si * vy) * mr / (d / 2) ELSE x END AS fx, CASE WHEN d > 0 THEN (y + y2) / 2 + (co * vy - si * vx) * mr / (d / 2) ELSE y END AS fy FROM tg2)
"""


@register("tangent_points", _TANGENTS + "SELECT drawing_id, contour_id, count(*) AS n, round(sum(fx), 2) + 0.0 AS sx, round(sum(fy), 2) + 0.0 AS sy, round(sum(fx * fy), 0) + 0.0 AS sxy FROM tg GROUP BY ALL", 2)
def tangent_points(spark, sf):
    """The tangent points of all branches, told by branch: their number and sums."""
    found = _tangents(spark, sf).groupBy("drawing_id", "contour_id")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("fx").alias("sx"), F.sum("fy").alias("sy"), F.round(F.sum(F.col("fx") * F.col("fy")), 0).alias("sxy"))


@register(
    "scores_to_drawing",
    _TANGENTS
    + """, v AS (SELECT DISTINCT drawing_id, x AS px, y AS py FROM points),
hit AS (SELECT v.drawing_id, px, py, contour_id, round((px - fx) * (px - fx) + (py - fy) * (py - fy), 9) AS d, score FROM v JOIN tg ON tg.drawing_id = v.drawing_id AND abs(px - fx) < 4 AND abs(py - fy) < 4),
best AS (SELECT drawing_id, px, py, contour_id, min(ROW(d, -score)) AS m FROM hit WHERE d < 16 GROUP BY ALL)
SELECT drawing_id, px AS x, py AS y, round(max(-m[2]), 4) + 0.0 AS score FROM best GROUP BY ALL""",
)
def scores_to_drawing(spark, sf):
    """The separation of branches told to the vertices of their drawing."""
    vertices = branches(spark, sf).select("drawing_id", "x", "y").distinct()
    return medial.scores_to_points(vertices, _tangents(spark, sf))


@register(
    "scores_along_contours",
    """, l AS (SELECT drawing_id, contour_id, CAST(trunc(x1) AS INT) AS a, CAST(trunc(y1) AS INT) AS b, CAST(trunc(x2) AS INT) AS c, CAST(trunc(y2) AS INT) AS d FROM seg),
n AS (SELECT *, greatest(abs(c - a), abs(d - b)) AS n FROM l), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n),
p AS (SELECT DISTINCT drawing_id, contour_id, CAST(floor(b + (d - b) * k / greatest(n, 1) + 0.5) AS BIGINT) AS y, CAST(floor(a + (c - a) * k / greatest(n, 1) + 0.5) AS BIGINT) AS x FROM k),
s AS (SELECT drawing_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, max(r) AS score FROM branch GROUP BY ALL)
SELECT p.drawing_id, contour_id, count(*) AS n, round(avg(score), 4) + 0.0 AS score FROM p JOIN s ON s.drawing_id = p.drawing_id AND s.y = p.y AND s.x = p.x WHERE score <> 0 GROUP BY ALL""",
)
def scores_along_contours(spark, sf):
    scores = branches(spark, sf).groupBy("drawing_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.max("r").alias("score"))
    return medial.scores_along_contours(segments(spark, sf), scores)


# -- scenes -------------------------------------------------------------------

_CATEGORIES = ["beach", "city", "forest", "highway", "mountain", "office"]


def _wide_sql(short: str, bin_: str, source: str, value: str) -> str:
    sums = ", ".join(f"coalesce(sum({value}) FILTER ({bin_} = {b}), 0.0) AS {short}_{b + 1}" for b in range(8))
    return f"(SELECT drawing_id, {sums} FROM {source} GROUP BY 1)"


@register(
    "scene_table",
    f""", fc AS (SELECT feat.*, clen FROM feat JOIN cont USING (drawing_id, contour_id) WHERE clen > 0)
SELECT drawing_id, ['{"', '".join(_CATEGORIES)}'][CAST(drawing_id % 6 AS INT) + 1] AS category, 'scene_' || drawing_id AS image_name,
"""
    + ", ".join(f"round({s}_{b + 1}, 4) + 0.0 AS {s}_{b + 1}" for s in ("len", "curv") for b in range(8))
    + " FROM (SELECT DISTINCT drawing_id FROM seg) d LEFT JOIN "
    + _wide_sql("len", line_queries._LEN_BIN, "cont WHERE clen > 0", "10000.0")
    + " a USING (drawing_id) LEFT JOIN "
    + _wide_sql("curv", line_queries._CURV_BIN, "fc", "len / clen * 10000")
    + " b USING (drawing_id)",
)
def scene_table(spark, sf):
    seg, bins = line_queries.featured(spark, sf), list(range(8))
    category = F.element_at(F.array(*[F.lit(c) for c in _CATEGORIES]), (F.col("drawing_id") % 6 + 1).cast("int"))
    scenes = seg.select("drawing_id").distinct().select("drawing_id", category.alias("category"), F.format_string("scene_%d", "drawing_id").alias("image_name"))
    return stats.scene_table(scenes, {"len": (stats.length_stats(seg, WIDTH, HEIGHT), bins), "curv": (stats.curvature_stats(seg), bins)})
