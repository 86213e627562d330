"""Queries over line drawings, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeframe.operators import geometry as geo
from strokeframe.operators import junctions as jun
from strokeframe.operators import medial, split, stats

from strokeframe.tables import written

from .fixtures import HEIGHT, RASTER_H, RASTER_W, SQL, WIDTH, branches, raw_pixels, segments, sizes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every double column rounded, with no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, sql: str | None = None, digits: int = 4):
    def keep(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLE[name] = SQL + sql
        return f

    return keep


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.with_properties(segments(spark, sf_dir))


ID = "drawing_id, contour_id, seg_id"


@register("seg_length", f"SELECT {ID}, round(len, 4) + 0.0 AS len FROM feat")
def seg_length(spark, sf):
    return geo.with_length(segments(spark, sf)).select(*geo.SEGMENT, "len")


@register("contour_length", "SELECT drawing_id, contour_id, round(clen, 4) + 0.0 AS clen FROM cont")
def contour_length(spark, sf):
    return geo.contour_lengths(segments(spark, sf))


@register("seg_orientation", f"SELECT {ID}, round(ori, 4) + 0.0 AS ori FROM feat")
def seg_orientation(spark, sf):
    return geo.with_orientation(segments(spark, sf)).select(*geo.SEGMENT, "ori")


@register("seg_curvature", f"SELECT {ID}, round(curv, 4) + 0.0 AS curv FROM feat")
def seg_curvature(spark, sf):
    return featured(spark, sf).select(*geo.SEGMENT, "curv")


def _hist_sql(bin_: str, source: str = "feat", weight: str = "len") -> str:
    return f""", h0 AS (SELECT drawing_id, contour_id, CAST({bin_} AS INTEGER) AS bin, sum({weight}) AS value FROM {source} GROUP BY ALL),
h1 AS (SELECT h0.*, CASE WHEN clen > 0 THEN value / clen * 10000 ELSE 0.0 END AS norm_value FROM h0 JOIN cont USING (drawing_id, contour_id))
SELECT drawing_id, contour_id, bin, round(sum(value), 4) + 0.0 AS value, round(sum(norm_value), 4) + 0.0 AS norm_value
FROM h1 GROUP BY GROUPING SETS ((drawing_id, contour_id, bin), (drawing_id, bin))"""


_HV = "round(abs(cos(radians(ori))) - abs(sin(radians(ori))), 9)"
_HV_BIN = f"greatest(least(floor(({_HV} + 1) / 0.25), 7), 0)"
_CURV_BIN = "greatest(least(floor(round((log10(curv + 1) - log10(1)) / ((log10(91) - log10(1)) / 8), 9)), 7), 0)"
_LEN_BIN = "greatest(least(floor(round((log10(clen + 1) - log10(3)) / ((log10(1121) - log10(3)) / 8), 9)), 7), 0)"


@register("hist_orientation", _hist_sql("least(floor((ori + 11.25) % 180 / 22.5), 7)"))
def hist_orientation(spark, sf):
    return stats.orientation_stats(featured(spark, sf))


@register("hist_curvature", _hist_sql(_CURV_BIN))
def hist_curvature(spark, sf):
    return stats.curvature_stats(featured(spark, sf))


@register("hist_horver", _hist_sql(_HV_BIN))
def hist_horver(spark, sf):
    return stats.horizontal_vertical_stats(featured(spark, sf))


@register("hist_length", _hist_sql(_LEN_BIN, "cont", "clen"))
def hist_length(spark, sf):
    return stats.length_stats(segments(spark, sf), WIDTH, HEIGHT)


@register(
    "feature_table_wide",
    """, h AS (SELECT drawing_id, contour_id, CAST(least(floor((ori + 11.25) % 180 / 22.5), 7) AS INTEGER) AS bin, sum(len) AS v FROM feat GROUP BY ALL),
n AS (SELECT h.drawing_id, bin, CASE WHEN clen > 0 THEN v / clen * 10000 ELSE 0.0 END AS v FROM h JOIN cont USING (drawing_id, contour_id)),
k AS (SELECT drawing_id, CAST("""
    + _HV_BIN
    + """ AS INTEGER) AS bin, len / clen * 10000 AS v FROM feat JOIN cont USING (drawing_id, contour_id) WHERE clen > 0),
a AS (SELECT drawing_id, """
    + ", ".join(f"round(coalesce(sum(v) FILTER (bin = {b}), 0.0), 4) + 0.0 AS ori_{b + 1}" for b in range(8))
    + " FROM n GROUP BY 1), c AS (SELECT drawing_id, "
    + ", ".join(f"round(coalesce(sum(v) FILTER (bin = {b}), 0.0), 4) + 0.0 AS hv_{b + 1}" for b in range(8))
    + " FROM k GROUP BY 1) SELECT * FROM a JOIN c USING (drawing_id)",
)
def feature_table_wide(spark, sf):
    seg, bins = featured(spark, sf), list(range(8))
    wide = stats.wide_table(stats.orientation_stats(seg), "ori", bins)
    return wide.join(stats.wide_table(stats.horizontal_vertical_stats(seg), "hv", bins), "drawing_id")


@register("avg_length", "SELECT drawing_id, round(avg(clen), 4) + 0.0 AS avg_len FROM cont GROUP BY 1")
def avg_length(spark, sf):
    return stats.average_length(segments(spark, sf))


@register("avg_curvature", "SELECT drawing_id, round(sum(curv * len) / sum(len), 4) + 0.0 AS avg_curv FROM feat GROUP BY 1")
def avg_curvature(spark, sf):
    return stats.average_curvature(featured(spark, sf))


@register(
    "avg_orientation",
    """, s AS (SELECT drawing_id, sum(CASE WHEN ori > 180 THEN x1 - x2 ELSE x2 - x1 END) AS sx, sum(CASE WHEN ori > 180 THEN y1 - y2 ELSE y2 - y1 END) AS sy FROM feat GROUP BY 1)
SELECT drawing_id, round((degrees(atan2(-sy, sx)) + 360) % 180, 4) + 0.0 AS avg_ori FROM s""",
)
def avg_orientation(spark, sf):
    return stats.average_orientation(featured(spark, sf))


_ROT = "round(({x} - 320.0) * 0.86603 - ({y} - 240.0) * 0.5 + 320.0, 6) + 0.0", "round(({x} - 320.0) * 0.5 + ({y} - 240.0) * 0.86603 + 240.0, 6) + 0.0"


@register("rotate_30", f"SELECT {ID}, " + ", ".join(f"{_ROT[a].format(x=f'x{k}', y=f'y{k}')} AS {'xy'[a]}{k}" for k in (1, 2) for a in (0, 1)) + " FROM seg", 6)
def rotate_30(spark, sf):
    return geo.rotate(segments(spark, sf), 30, WIDTH, HEIGHT)


@register(
    "aperture_clip",
    """, g AS (SELECT *, x1 - 320.0 AS px, y1 - 240.0 AS py, x2 - x1 AS dx, y2 - y1 AS dy,
  sqrt((x1 - 320.0) ** 2 + (y1 - 240.0) ** 2) <= 240 AS in1, sqrt((x2 - 320.0) ** 2 + (y2 - 240.0) ** 2) <= 240 AS in2 FROM seg),
m AS (SELECT *, dx * dx + dy * dy AS a, 2 * (px * dx + py * dy) AS b, px * px + py * py - 57600 AS c FROM g WHERE in1 OR in2),
t AS (SELECT *, CASE WHEN in1 AND in2 THEN NULL WHEN in1 THEN (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a)
  ELSE (-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) END AS t FROM m),
f AS (SELECT *, CASE WHEN in1 AND coalesce(lag(in1 AND in2) OVER w AND lag(seg_id) OVER w = seg_id - 1, false) THEN 0 ELSE 1 END AS fresh
  FROM t WINDOW w AS (PARTITION BY drawing_id, contour_id ORDER BY seg_id))
SELECT drawing_id, contour_id, CAST(sum(fresh) OVER (PARTITION BY drawing_id, contour_id ORDER BY seg_id) AS BIGINT) AS piece, seg_id,
  round(CASE WHEN in1 THEN x1 ELSE x1 + t * dx END, 4) + 0.0 AS x1, round(CASE WHEN in1 THEN y1 ELSE y1 + t * dy END, 4) + 0.0 AS y1,
  round(CASE WHEN in2 THEN x2 ELSE x1 + t * dx END, 4) + 0.0 AS x2, round(CASE WHEN in2 THEN y2 ELSE y1 + t * dy END, 4) + 0.0 AS y2 FROM f""",
)
def aperture_clip(spark, sf):
    return geo.clip_to_circle(segments(spark, sf), WIDTH, HEIGHT)


@register(
    "chord_distance",
    """, e AS (SELECT drawing_id, contour_id, arg_min(x1, seg_id) AS ax, arg_min(y1, seg_id) AS ay, arg_max(x2, seg_id) AS bx, arg_max(y2, seg_id) AS by_, max(seg_id) AS last FROM seg GROUP BY ALL),
d AS (SELECT drawing_id, contour_id, CASE WHEN bx <> ax OR by_ <> ay THEN abs((bx - ax) * (ay - y2) - (ax - x2) * (by_ - ay)) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)
  ELSE sqrt((x2 - ax) ** 2 + (y2 - ay) ** 2) END AS d FROM seg JOIN e USING (drawing_id, contour_id) WHERE seg_id < last)
SELECT e.drawing_id, e.contour_id, round(coalesce(avg(d), 0), 4) + 0.0 AS dist FROM e LEFT JOIN d ON e.drawing_id = d.drawing_id AND e.contour_id = d.contour_id GROUP BY ALL""",
)
def chord_distance(spark, sf):
    return geo.chord_distance(segments(spark, sf))


@register(
    "color_index_length",
    """, l AS (SELECT *, log10(clen + 1) AS v FROM cont), b AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM l WINDOW w AS (PARTITION BY drawing_id))
SELECT drawing_id, contour_id, CASE WHEN hi > lo THEN least(round_even((v - lo) / (hi - lo) * 255 + 1, 0), 256) ELSE 1.0 END + 0.0 AS color FROM b""",
)
def color_index_length(spark, sf):
    lengths = geo.contour_lengths(segments(spark, sf))
    return geo.color_index(lengths, F.log10(F.col("clen") + 1), ["drawing_id"]).select(*geo.CONTOUR, "color")


@register(
    "color_index_curvature",
    f""", l AS (SELECT *, log10(curv + 1) AS v FROM feat), b AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w * 0.8 AS hi FROM l WINDOW w AS (PARTITION BY drawing_id))
SELECT {ID}, CASE WHEN hi > lo THEN least(round_even((v - lo) / (hi - lo) * 255 + 1, 0), 256) ELSE 1.0 END + 0.0 AS color FROM b""",
)
def color_index_curvature(spark, sf):
    return geo.color_index(featured(spark, sf), F.log10(F.col("curv") + 1), ["drawing_id"], 0.8).select(*geo.SEGMENT, "color")


@register("color_index_orientation", f"SELECT {ID}, round_even(ori % 180 / 180 * 255 + 1, 0) + 0.0 AS color FROM feat")
def color_index_orientation(spark, sf):
    return geo.orientation_color(featured(spark, sf)).select(*geo.SEGMENT, "color")


#: Every 11th contour shrunk to its first points, segment by segment.
_SHRUNK = """, shrunk AS (SELECT drawing_id, contour_id, seg_id, x1, y1, CASE WHEN contour_id % 11 = 0 THEN x1 ELSE x2 END AS x2, CASE WHEN contour_id % 11 = 0 THEN y1 ELSE y2 END AS y2 FROM seg)
"""


@register(
    "drop_zero_length",
    _SHRUNK + f"SELECT {ID} FROM shrunk SEMI JOIN (SELECT drawing_id, contour_id FROM shrunk GROUP BY ALL HAVING sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) > 0) USING (drawing_id, contour_id)",
)
def drop_zero_length(spark, sf):
    """Contours without length are dropped; every 11th is made one."""
    none = F.col("contour_id") % 11 == 0
    shrunk = segments(spark, sf).withColumns({f"{c}2": F.when(none, F.col(f"{c}1")).otherwise(F.col(f"{c}2")) for c in "xy"})
    return geo.drop_zero_length(shrunk)[0].select(*geo.SEGMENT)


@register(
    "keep_long_contours",
    f""", q AS (SELECT drawing_id, quantile_cont(clen, 0.6) AS cut FROM cont GROUP BY 1)
SELECT {ID} FROM seg JOIN cont USING (drawing_id, contour_id) JOIN q USING (drawing_id) WHERE clen >= cut""",
)
def keep_long_contours(spark, sf):
    return geo.keep_long_contours(segments(spark, sf), 60).select(*geo.SEGMENT)


@register(
    "points_in_tile",
    f"""SELECT {ID}, px, py FROM (SELECT {ID}, x1 AS px, y1 AS py FROM seg UNION ALL SELECT {ID}, x2, y2 FROM seg)
WHERE px >= 200 AND px < 328 AND py >= 100 AND py < 228""",
)
def points_in_tile(spark, sf):
    return geo.points_in_tile(segments(spark, sf), 100, 200, 128)


@register(
    "middle_vs_ends",
    f""", r AS (SELECT *, sum(len) OVER (PARTITION BY drawing_id, contour_id ORDER BY seg_id) AS s2, sum(len) OVER (PARTITION BY drawing_id, contour_id) AS total FROM feat),
p AS (SELECT r.*, part, greatest(s2 - len, total * lo) AS a, least(s2, total * hi) AS b FROM r, (VALUES ('head', 0.0, 0.25), ('middle', 0.25, 0.75), ('tail', 0.75, 1.0)) v(part, lo, hi))
SELECT part, count(*) AS n, round(sum(b - a), 2) + 0.0 AS total FROM p WHERE b > a AND b - a > 1e-6 GROUP BY 1""",
)
def middle_vs_ends(spark, sf):
    pieces = geo.with_length(geo.middle_and_ends(segments(spark, sf))).where("len > 1e-6")
    return pieces.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("len"), 2).alias("total"))


@register("value_counts", "SELECT x1, y1, count(*) AS n FROM seg GROUP BY ALL")
def value_counts(spark, sf):
    return stats.value_counts(segments(spark, sf), "x1", "y1")


# -- junctions ----------------------------------------------------------------


def _junction_sql(source: str) -> str:
    return f""", jl AS (SELECT drawing_id, contour_id FROM (SELECT drawing_id, contour_id, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS l FROM {source} GROUP BY ALL) WHERE l >= 1),
js AS (SELECT * FROM {source} SEMI JOIN jl USING (drawing_id, contour_id)),
jp AS (SELECT q.drawing_id, q.contour_id AS c1, q.seg_id AS s1, r.contour_id AS c2, r.seg_id AS s2, q.x1 AS qx1, q.y1 AS qy1, q.x2 AS qx2, q.y2 AS qy2,
  r.x1 AS rx1, r.y1 AS ry1, r.x2 AS rx2, r.y2 AS ry2, q.x2 - q.x1 AS ux, q.y2 - q.y1 AS uy, r.x2 - r.x1 AS vx, r.y2 - r.y1 AS vy
  FROM js q JOIN js r ON q.drawing_id = r.drawing_id AND q.contour_id < r.contour_id),
jd AS (SELECT *, ux * vy - uy * vx AS d FROM jp),
ja AS (SELECT *, ((rx1 - qx1) * vy - (ry1 - qy1) * vx) / d AS a, ((rx1 - qx1) * uy - (ry1 - qy1) * ux) / d AS b,
  least(0.3, 1.0 / greatest(abs(ux), abs(uy))) AS ta, least(0.3, 1.0 / greatest(abs(vx), abs(vy))) AS tb FROM jd WHERE d <> 0),
junc AS MATERIALIZED (SELECT drawing_id, c1, s1, c2, s2,
  CASE WHEN abs(a) < 1e-4 THEN qx1 WHEN abs(a - 1) < 1e-4 THEN qx2 WHEN abs(b) < 1e-4 THEN rx1 WHEN abs(b - 1) < 1e-4 THEN rx2 ELSE qx1 + a * ux END AS x,
  CASE WHEN abs(a) < 1e-4 THEN qy1 WHEN abs(a - 1) < 1e-4 THEN qy2 WHEN abs(b) < 1e-4 THEN ry1 WHEN abs(b - 1) < 1e-4 THEN ry2 ELSE qy1 + a * uy END AS y
  FROM ja WHERE a BETWEEN -ta AND 1 + ta AND b BETWEEN -tb AND 1 + tb)
"""


@register("junction_counts", _junction_sql("seg") + "SELECT drawing_id, count(*) AS n, round(sum(x), 2) + 0.0 AS sx, round(sum(y), 2) + 0.0 AS sy FROM junc GROUP BY 1")
def junction_counts(spark, sf):
    found = jun.detect(segments(spark, sf, dealt=True), sizes=sizes(spark, sf))
    return found.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("sx"), F.round(F.sum("y"), 2).alias("sy"))


@register("junction_positions", _junction_sql("seg") + "SELECT drawing_id, c1, s1, c2, s2, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM junc")
def junction_positions(spark, sf):
    return jun.detect(segments(spark, sf, dealt=True), sizes=sizes(spark, sf))


@register(
    "junction_merge_pairs",
    _junction_sql("seg")
    + """, o(d) AS (VALUES (-1), (0), (1)), jc AS MATERIALIZED (SELECT *, CAST(floor(x / 2) AS BIGINT) AS gx, CAST(floor(y / 2) AS BIGINT) AS gy FROM junc),
nb AS (SELECT * REPLACE (gx + a.d AS gx, gy + b.d AS gy) FROM jc, o a, o b)
SELECT i.drawing_id, i.c1 AS i_c1, i.s1 AS i_s1, i.c2 AS i_c2, i.s2 AS i_s2, j.c1 AS j_c1, j.s1 AS j_s1, j.c2 AS j_c2, j.s2 AS j_s2
FROM jc i JOIN nb j ON i.drawing_id = j.drawing_id AND i.gx = j.gx AND i.gy = j.gy
WHERE (i.c1, i.s1, i.c2, i.s2) < (j.c1, j.s1, j.c2, j.s2) AND (i.x - j.x) ** 2 + (i.y - j.y) ** 2 <= 4""",
)
def junction_merge_pairs(spark, sf):
    return jun.meeting_pairs(segments(spark, sf, dealt=True), sizes=sizes(spark, sf))


@register("junction_types_merged")
def junction_types_merged(spark, sf):
    """The types of the merged junctions, the contours' counts of them, and the drawings' averages, told by drawing."""
    seg = segments(spark, sf, dealt=True)
    lengths, counts = geo.contour_lengths(seg), written(jun.type_counts(jun.compute(seg, sizes=sizes(spark, sf))), "typed")
    return counts.join(jun.average(counts, lengths), "drawing_id")


@register("split_junctions_merged")
def split_junctions_merged(spark, sf):
    """Contours split by the number of merged junctions."""
    seg = segments(spark, sf, dealt=True)
    return split.split_by_properties(jun.criterion(jun.compute(seg, sizes=sizes(spark, sf)), geo.contour_lengths(seg)), {"junctions": 1.0}).select("drawing_id", "contour_id", "rank", "share", "bottom", "top")


@register("junction_middles")
def junction_middles(spark, sf):
    """Pieces of contours between merged junctions, cut at a quarter and three quarters, told by contour and part."""
    seg = segments(spark, sf, dealt=True)
    pieces = geo.with_length(jun.middles(seg, jun.compute(seg, sizes=sizes(spark, sf))))
    return pieces.groupBy("drawing_id", "contour_id", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("len"), 2).alias("total"))


@register("junction_classes")
def junction_classes(spark, sf):
    return jun.merged_meetings(segments(spark, sf, dealt=True), sizes=sizes(spark, sf))


_TYPED_SQL = (
    _junction_sql("seg")
    + """, jm AS (SELECT drawing_id, c1, s1, c2, s2, x, y, c1 AS c, s1 AS s, c2 AS oc, s2 AS os FROM junc UNION ALL SELECT drawing_id, c1, s1, c2, s2, x, y, c2, s2, c1, s1 FROM junc),
jn AS (SELECT m.*, f.ori, g.ori AS prev, h.ori AS nxt, (x - f.x1) ** 2 + (y - f.y1) ** 2 < 4 AS st, (x - f.x2) ** 2 + (y - f.y2) ** 2 < 4 AS en,
  (degrees(atan2(y - f.y1, x - f.x1)) + 360) % 360 AS t1, (degrees(atan2(y - f.y2, x - f.x2)) + 360) % 360 AS t2
  FROM jm m JOIN feat f ON m.c = f.contour_id AND m.s = f.seg_id LEFT JOIN feat g ON m.c = g.contour_id AND m.s - 1 = g.seg_id AND NOT (m.oc = m.c AND m.os = m.s - 1)
  LEFT JOIN feat h ON m.c = h.contour_id AND m.s + 1 = h.seg_id AND NOT (m.oc = m.c AND m.os = m.s + 1)),
jo AS (SELECT drawing_id, c1, s1, c2, s2, unnest(CASE WHEN st THEN [ori, (prev + 180) % 360] WHEN en THEN [(ori + 180) % 360, nxt] ELSE [t1, t2] END) AS o FROM jn),
jg AS (SELECT *, coalesce(lead(o) OVER w, first_value(o) OVER w + 360) - o AS gap FROM jo WHERE o IS NOT NULL WINDOW w AS (PARTITION BY drawing_id, c1, s1, c2, s2 ORDER BY o)),
jt AS (SELECT drawing_id, c1, s1, c2, s2, count(*) AS n, min((gap + 360) % 360) AS lo, max((gap + 360) % 360) AS hi FROM jg GROUP BY ALL HAVING count(*) > 2),
typed AS (SELECT *, CASE WHEN n = 3 THEN CASE WHEN hi < 160 THEN 'Y' WHEN hi <= 200 THEN 'T' ELSE 'Arrow' END WHEN n = 4 THEN 'X' ELSE 'Star' END AS type FROM jt)
"""
)


@register("junction_angles_types", _TYPED_SQL + "SELECT drawing_id, c1, s1, c2, s2, round(lo, 4) + 0.0 AS min_angle, round(hi, 4) + 0.0 AS max_angle, type FROM typed")
def junction_angles_types(spark, sf):
    return jun.typed_meetings(segments(spark, sf, dealt=True), sizes=sizes(spark, sf)).select("drawing_id", "junction_id.*", "min_angle", "max_angle", "type")


@register("junction_type_hist", _TYPED_SQL + "SELECT drawing_id, type, count(*) AS n FROM typed GROUP BY ALL")
def junction_type_hist(spark, sf):
    return jun.meeting_types(segments(spark, sf, dealt=True), sizes=sizes(spark, sf))


@register(
    "junction_contour_hist",
    _TYPED_SQL
    + """SELECT u.drawing_id, u.contour_id, type, n, round(n / clen * 10000, 4) + 0.0 AS norm FROM (SELECT drawing_id, contour_id, type, count(*) AS n
  FROM (SELECT drawing_id, type, unnest([c1, c2]) AS contour_id FROM typed) GROUP BY ALL) u JOIN cont USING (drawing_id, contour_id)""",
)
def junction_contour_hist(spark, sf):
    return jun.meeting_contours(segments(spark, sf, dealt=True), sizes=sizes(spark, sf))


@register("junction_angle_hist", _TYPED_SQL + "SELECT drawing_id, CAST(least(floor(round(lo, 9) / 15), 7) AS INTEGER) AS bin, count(*) AS n FROM typed GROUP BY ALL")
def junction_angle_hist(spark, sf):
    return jun.meeting_angles(segments(spark, sf, dealt=True), sizes=sizes(spark, sf))


# -- splits -------------------------------------------------------------------

_CRITERIA = """, crit AS (SELECT drawing_id, contour_id, sum(len) AS length, sum(curv * len) AS curvature,
  sum((abs(cos(radians(ori))) - abs(sin(radians(ori)))) * len) AS orientation FROM feat GROUP BY ALL)
"""


def _split_sql(rank: str) -> str:
    return f"""{_CRITERIA}, ranked AS (SELECT *, {rank} AS rank FROM crit),
cum AS (SELECT drawing_id, contour_id, round(sum(length) OVER (PARTITION BY drawing_id ORDER BY rank, contour_id ROWS UNBOUNDED PRECEDING)
  / sum(length) OVER (PARTITION BY drawing_id), 9) AS share FROM ranked)
SELECT drawing_id, contour_id, round(share, 4) + 0.0 AS share, share <= 0.5 AS bottom, share >= 0.5 AS top FROM cum"""


def _rank(name: str) -> str:
    return f"row_number() OVER (PARTITION BY drawing_id ORDER BY round({name}, 9), contour_id)"


def _split(weights: dict[str, float]):
    def run(spark, sf):
        return split.split_by_properties(split.criteria(featured(spark, sf)), weights).select(*geo.CONTOUR, "share", "bottom", "top")

    return run


for _name in ("length", "curvature", "orientation"):
    register(f"split_{_name}", _split_sql(_rank(_name)))(_split({_name: 1.0}))
register("split_weighted", _split_sql(f"0.25 * {_rank('length')} + 0.75 * {_rank('curvature')}"))(_split({"length": 0.25, "curvature": 0.75}))

_WEIGHTS = [0.5, -0.25, 1.0, 0.0, 0.25, -1.0, 0.75, 0.125]


@register(
    "split_hist_weights",
    f""", h AS (SELECT drawing_id, contour_id, CAST(least(floor((ori + 11.25) % 180 / 22.5), 7) AS INTEGER) AS bin, sum(len) AS v FROM feat GROUP BY ALL),
sc AS (SELECT h.drawing_id, h.contour_id, any_value(clen) AS length, round(sum(CASE WHEN clen > 0 THEN v / clen * 10000 ELSE 0 END * {_WEIGHTS}[bin + 1]), 6) AS score
  FROM h JOIN cont USING (drawing_id, contour_id) GROUP BY ALL),
cum AS (SELECT drawing_id, contour_id, round(sum(length) OVER (PARTITION BY drawing_id ORDER BY score, contour_id ROWS UNBOUNDED PRECEDING)
  / sum(length) OVER (PARTITION BY drawing_id), 9) AS share FROM sc)
SELECT drawing_id, contour_id, round(share, 4) + 0.0 AS share, share <= 0.5 AS bottom, share >= 0.5 AS top FROM cum""",
)
def split_hist_weights(spark, sf):
    seg = featured(spark, sf)
    scores = split.histogram_score(stats.orientation_stats(seg), _WEIGHTS)
    contours = geo.contour_lengths(seg).withColumnRenamed("clen", "length").join(scores, geo.CONTOUR)
    return split.cumulative_split(contours, F.round("score", 6)).select(*geo.CONTOUR, "share", "bottom", "top")


@register(
    "dup_contours",
    """, dseg AS MATERIALIZED (SELECT drawing_id, contour_id, x1, y1, x2, y2 FROM seg UNION ALL
  SELECT drawing_id, contour_id + 10000000, x1 + 0.5, y1 + 0.25, x2 + CASE WHEN contour_id % 2 = 0 THEN 0.5 ELSE 0.75 END, y2 + 0.25 FROM seg WHERE contour_id % 13 = 0),
dcont AS (SELECT drawing_id, contour_id, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS clen FROM dseg GROUP BY ALL),
v AS (SELECT DISTINCT drawing_id, contour_id, x, y FROM (SELECT drawing_id, contour_id, x1 AS x, y1 AS y FROM dseg UNION ALL SELECT drawing_id, contour_id, x2, y2 FROM dseg)),
n AS (SELECT a.drawing_id, a.contour_id AS a, b.contour_id AS b, a.x, a.y, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM v a JOIN v b ON a.drawing_id = b.drawing_id AND a.contour_id <> b.contour_id GROUP BY ALL),
m AS (SELECT drawing_id, a, b, max(d) AS d FROM n GROUP BY ALL)
SELECT DISTINCT m.drawing_id, m.a AS contour_id FROM m JOIN m k ON m.drawing_id = k.drawing_id AND m.a = k.b AND m.b = k.a AND m.d < 1 AND k.d < 1
JOIN dcont p ON p.contour_id = m.a JOIN dcont q ON q.contour_id = m.b WHERE round(p.clen, 9) < round(q.clen, 9) OR (round(p.clen, 9) = round(q.clen, 9) AND m.a > m.b)""",
)
def dup_contours(spark, sf):
    """Contours that lie on others are dropped; every 13th has a copy beside it, of which half are a little longer or shorter."""
    seg = segments(spark, sf)
    longer = F.when(F.col("contour_id") % 2 == 0, 0.5).otherwise(0.75)
    beside = seg.where("contour_id % 13 = 0").withColumns({"x1": F.col("x1") + 0.5, "y1": F.col("y1") + 0.25, "x2": F.col("x2") + longer, "y2": F.col("y2") + 0.25})
    return split.duplicate_contours(seg.unionByName(beside.withColumn("contour_id", F.col("contour_id") + 10_000_000)))


@register(
    "segment_at_junctions",
    _junction_sql("seg")
    + """, met AS (SELECT DISTINCT drawing_id, contour_id, seg_id, x, y FROM (SELECT drawing_id, c1 AS contour_id, s1 AS seg_id, x, y FROM junc UNION ALL SELECT drawing_id, c2, s2, x, y FROM junc)),
cuts AS (SELECT a.drawing_id, a.contour_id, a.seg_id, list({'x': x, 'y': y} ORDER BY sqrt((x - x1) ** 2 + (y - y1) ** 2), x, y) AS cuts FROM met a JOIN seg USING (drawing_id, contour_id, seg_id) GROUP BY ALL),
way AS (SELECT drawing_id, contour_id, seg_id, list_concat([{'x': x1, 'y': y1}], coalesce(cuts, []), [{'x': x2, 'y': y2}]) AS p FROM seg LEFT JOIN cuts USING (drawing_id, contour_id, seg_id)),
part AS (SELECT drawing_id, contour_id, seg_id, k, p[k + 1] AS a, p[k + 2] AS b FROM (SELECT *, unnest(range(0, len(p) - 1)) AS k FROM way)),
kept AS (SELECT * FROM part WHERE a.x <> b.x OR a.y <> b.y)
SELECT drawing_id, contour_id, CAST(sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY drawing_id, contour_id ORDER BY seg_id, k) AS BIGINT) AS piece, seg_id,
  round(a.x, 4) + 0.0 AS x1, round(a.y, 4) + 0.0 AS y1, round(b.x, 4) + 0.0 AS x2, round(b.y, 4) + 0.0 AS y2 FROM kept""",
)
def segment_at_junctions(spark, sf):
    seg = segments(spark, sf)
    found = jun.detect(seg)
    at = [found.select("drawing_id", F.col(c).alias("contour_id"), F.col(s).alias("seg_id"), "x", "y") for c, s in (("c1", "s1"), ("c2", "s2"))]
    return split.split_at_junctions(seg, at[0].unionByName(at[1]))


@register("merge_lines")
def merge_lines(spark, sf):
    """Straight runs merged, and contours that then lie on others dropped."""
    return split.merge_lines(segments(spark, sf), 20.0, 12.0)


@register("merge_line_segments")
def merge_line_segments(spark, sf):
    return split.merge_straight_runs(segments(spark, sf), 20.0)


@register("shift_contours")
def shift_contours(spark, sf):
    return geo.shift_contours(segments(spark, sf), WIDTH, HEIGHT, 20, 42)


@register(
    "svg_import",
    """SELECT CAST(drawing_id AS VARCHAR) || '.svg' AS filename, dense_rank() OVER (PARTITION BY drawing_id ORDER BY contour_id) - 1 AS contour_id, seg_id, x1, y1, x2, y2,
CAST(640 AS BIGINT) AS width, CAST(480 AS BIGINT) AS height, CAST(NULL AS VARCHAR) AS error FROM seg""",
)
def svg_import(spark, sf):
    """The drawings written as SVG text and read again."""
    from strokeframe.sources.svg import parse_files, svg_text

    drawn = svg_text(segments(spark, sf), WIDTH, HEIGHT)
    return parse_files(drawn.select(F.concat(F.col("drawing_id").cast("string"), F.lit(".svg")).alias("path"), F.col("value").cast("binary").alias("content")))


@register(
    "hist_mat_property",
    """, sc AS (SELECT l_orderkey // 75 AS drawing_id, (l_partkey % 101) / 100.0 AS v FROM lineitem)
SELECT drawing_id, CAST(least(floor(v * 8), 7) AS INTEGER) AS bin, count(*) AS n FROM sc GROUP BY ALL""",
)
def hist_mat_property(spark, sf):
    from strokeframe.tables import read_table

    scores = read_table(spark, sf, "lineitem").select(F.expr("l_orderkey div 75").alias("drawing_id"), (F.col("l_partkey") % 101 / 100.0).alias("v"))
    return stats.score_stats(scores, "v")


@register(
    "split_linear_model",
    f""", h AS (SELECT drawing_id, contour_id, CAST({_HV_BIN} AS INTEGER) AS bin, sum(len) AS v FROM feat GROUP BY ALL),
sc AS (SELECT h.drawing_id, h.contour_id, any_value(clen) AS length, round(2.5 + sum(CASE WHEN clen > 0 THEN v / clen * 10000 ELSE 0 END * {_WEIGHTS}[bin + 1]), 6) AS score
  FROM h JOIN cont USING (drawing_id, contour_id) GROUP BY ALL),
cum AS (SELECT drawing_id, contour_id, round(sum(length) OVER (PARTITION BY drawing_id ORDER BY score, contour_id ROWS UNBOUNDED PRECEDING)
  / sum(length) OVER (PARTITION BY drawing_id), 9) AS share FROM sc)
SELECT drawing_id, contour_id, round(share, 4) + 0.0 AS share, share <= 0.5 AS bottom, share >= 0.5 AS top FROM cum""",
)
def split_linear_model(spark, sf):
    seg = featured(spark, sf)
    scores = stats.linear_scores(stats.horizontal_vertical_stats(seg), _WEIGHTS, 2.5)
    contours = geo.contour_lengths(seg).withColumnRenamed("clen", "length").join(scores, geo.CONTOUR)
    return split.cumulative_split(contours, F.round("score", 6)).select(*geo.CONTOUR, "share", "bottom", "top")


@register(
    "property_ranges",
    """, u AS (SELECT 'len' AS property, len AS v FROM feat UNION ALL SELECT 'ori', ori FROM feat UNION ALL SELECT 'curv', curv FROM feat)
SELECT property, round(min(v), 4) + 0.0 AS low, round(max(v), 4) + 0.0 AS high FROM u GROUP BY 1""",
)
def property_ranges(spark, sf):
    return stats.property_ranges(featured(spark, sf), ["len", "ori", "curv"])


@register(
    "density_map",
    """, l AS (SELECT drawing_id, contour_id * 1000 + seg_id AS o, CAST(trunc(x1) AS INT) AS a, CAST(trunc(y1) AS INT) AS b, CAST(trunc(x2) AS INT) AS c, CAST(trunc(y2) AS INT) AS d FROM seg),
n AS (SELECT *, greatest(abs(c - a), abs(d - b)) AS n FROM l), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n),
p AS (SELECT drawing_id, o, CAST(floor(b + (d - b) * k / greatest(n, 1) + 0.5) AS INTEGER) AS y, CAST(floor(a + (c - a) * k / greatest(n, 1) + 0.5) AS INTEGER) AS x FROM k),
m AS (SELECT drawing_id, y, x, arg_max(len, o) AS v FROM p JOIN (SELECT contour_id * 1000 + seg_id AS o, len FROM feat) USING (o) GROUP BY ALL)
SELECT drawing_id, y, count(*) AS n, round(sum(v), 2) + 0.0 AS value, round(sum(v * x), 0) + 0.0 AS moment FROM m GROUP BY ALL""",
)
def density_map(spark, sf):
    """The length of the segment painted last on each pixel, told by row: the number of pixels, the sum, and the sum by x."""
    return stats.density_rows(segments(spark, sf, dealt=True), sizes=sizes(spark, sf))


_TAPS = ", ".join(f"({k}, {g!r}::DOUBLE)" for k, g in zip(range(-8, 9), stats.gaussian(2), strict=True))


@register(
    "density_blur",
    f""", taps(k, g) AS (VALUES {_TAPS}),
down AS (SELECT raster_id, p AS y, x, sum(strength * g) AS v FROM raw_pix, range(0, {RASTER_H}) r(p), taps
  WHERE CASE WHEN (p + k + {4 * RASTER_H - 4}) % {2 * RASTER_H - 2} < {RASTER_H} THEN (p + k + {4 * RASTER_H - 4}) % {2 * RASTER_H - 2} ELSE {2 * RASTER_H - 2} - (p + k + {4 * RASTER_H - 4}) % {2 * RASTER_H - 2} END = y GROUP BY ALL),
across AS (SELECT raster_id, y, p AS x, sum(v * g) AS v FROM down, range(0, {RASTER_W}) r(p), taps
  WHERE CASE WHEN (p + k + {4 * RASTER_W - 4}) % {2 * RASTER_W - 2} < {RASTER_W} THEN (p + k + {4 * RASTER_W - 4}) % {2 * RASTER_W - 2} ELSE {2 * RASTER_W - 2} - (p + k + {4 * RASTER_W - 4}) % {2 * RASTER_W - 2} END = x GROUP BY ALL)
SELECT raster_id, y, x, round(v, 4) + 0.0 AS value FROM across""",
)
def density_blur(spark, sf):
    """Maps of the pixels' strengths smoothed by a Gaussian of two pixels."""
    painted = raw_pixels(spark, sf).select(F.col("raster_id").alias("drawing_id"), "y", "x", F.col("strength").alias("value"))
    return stats.blurred(painted, ["value"], 2, RASTER_H, RASTER_W).withColumnRenamed("drawing_id", "raster_id")


_POINT = "drawing_id, contour_id, pt"


@register("branch_derivatives", f"SELECT {_POINT}, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("rs", "dx", "dy", "dr")) + " FROM deriv")
def branch_derivatives(spark, sf):
    return medial.branch_derivatives(branches(spark, sf)).select("drawing_id", "contour_id", "pt", "rs", "dx", "dy", "dr")


@register(
    "branch_scores",
    f""", c AS (SELECT *, count(*) OVER (PARTITION BY contour_id) AS n, sum(sqrt(dx * dx + dy * dy)) OVER w AS flat, sum(sqrt(dx * dx + dy * dy + dr * dr)) OVER w AS full_
  FROM deriv WINDOW w AS (PARTITION BY contour_id ORDER BY pt ROWS UNBOUNDED PRECEDING)),
p AS (SELECT a.contour_id, a.pt, sum(b.flat) / sum(b.full_) AS v FROM c a JOIN c b ON a.contour_id = b.contour_id AND abs(b.pt - a.pt) <= least(5, a.pt - 1, a.n - a.pt - 1)
  WHERE a.pt > 0 AND a.pt < a.n - 1 GROUP BY ALL)
SELECT {_POINT}, round(1 - 1 / rs, 4) + 0.0 AS separation, round(coalesce(v, 0.0), 4) + 0.0 AS parallelism FROM c LEFT JOIN p USING (contour_id, pt)""",
)
def branch_scores(spark, sf):
    found = medial.parallelism(medial.separation(medial.branch_derivatives(branches(spark, sf))))
    return found.select("drawing_id", "contour_id", "pt", "separation", "parallelism")


_RATIO = """{c} AS (SELECT *, sum(sqrt(dx * dx + dy * dy)) OVER w AS flat, sum(sqrt(dx * dx + dy * dy + {third} * {third})) OVER w AS full_
  FROM {source} WINDOW w AS (PARTITION BY contour_id ORDER BY pt ROWS UNBOUNDED PRECEDING)),
{p} AS (SELECT a.contour_id, a.pt, sum(b.flat) / sum(b.full_) AS v FROM {c} a JOIN {c} b ON a.contour_id = b.contour_id AND abs(b.pt - a.pt) <= least(5, a.pt - 1, a.n - a.pt - 1)
  WHERE a.pt > 0 AND a.pt < a.n - 1 GROUP BY ALL)"""


@register(
    "branch_taper_mirror",
    f""", d0 AS (SELECT *, count(*) OVER (PARTITION BY contour_id) AS n, avg(dr) OVER (PARTITION BY contour_id ORDER BY pt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sdr FROM deriv),
d1 AS (SELECT *, coalesce(lead(sdr) OVER w - sdr, sdr - lag(sdr) OVER w, 0) AS ddr0 FROM d0 WINDOW w AS (PARTITION BY contour_id ORDER BY pt)),
d2 AS (SELECT *, avg(ddr0) OVER (PARTITION BY contour_id ORDER BY pt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ddr FROM d1),
{_RATIO.format(c="tc", p="tp", third="ddr", source="d2")}, {_RATIO.format(c="pc", p="pp", third="dr", source="d2")},
m0 AS (SELECT a.contour_id, a.pt, count(*) AS k, sum(b.x - a.x) AS sx, sum(b.y - a.y) AS sy, sum((b.x - a.x) ** 2) AS sxx, sum((b.y - a.y) ** 2) AS syy, sum((b.x - a.x) * (b.y - a.y)) AS sxy
  FROM d2 a JOIN d2 b ON a.contour_id = b.contour_id AND abs(b.pt - a.pt) <= greatest(1, least(5, a.pt - 1, a.n - a.pt - 1)) WHERE a.pt > 0 AND a.pt < a.n - 1 GROUP BY ALL),
m1 AS (SELECT contour_id, pt, sxx - sx * sx / k AS a, syy - sy * sy / k AS b, sxy - sx * sy / k AS c FROM m0),
m AS (SELECT contour_id, pt, CASE WHEN a + b > 1e-9 THEN (a + b + sqrt((a - b) ** 2 + 4 * c * c)) / 2 / (a + b) ELSE 0.0 END AS v FROM m1),
raw AS (SELECT d2.*, coalesce(tp.v, 0.0) AS taper0, coalesce(pp.v, 0.0) AS par0, coalesce(m.v, 0.0) AS mirror0 FROM d2
  LEFT JOIN tp USING (contour_id, pt) LEFT JOIN pp USING (contour_id, pt) LEFT JOIN m USING (contour_id, pt))
SELECT {_POINT}, """
    + ", ".join(f"round(pow(avg({c}0) OVER w, 10), 4) + 0.0 AS {n}" for c, n in (("taper", "taper"), ("par", "parallelism"), ("mirror", "mirror")))
    + " FROM raw WINDOW w AS (PARTITION BY contour_id ORDER BY pt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
)
def branch_taper_mirror(spark, sf):
    """Taper, parallelism and mirror symmetry of branches, smoothed and to the tenth power."""
    points = medial.branch_derivatives(branches(spark, sf))
    names = ["taper", "parallelism", "mirror"]
    for name in names:
        points = medial.sharpened(medial.SCORES[name](points), name)
    return points.select("drawing_id", "contour_id", "pt", *names)


@register(
    "contour_stats",
    "".join(
        f", {name} AS (SELECT * FROM (WITH {_hist_sql(*args)[2:]}))"
        for name, args in {"so": ("least(floor((ori + 11.25) % 180 / 22.5), 7)",), "sl": (_LEN_BIN, "cont", "clen")}.items()
    )
    + " SELECT 'orientation' AS property, * FROM so UNION ALL SELECT 'length', * FROM sl",
)
def contour_stats(spark, sf):
    return stats.contour_stats(featured(spark, sf), WIDTH, HEIGHT, ["Orientation", "length"])


@register(
    "score_levels",
    f""", h AS (SELECT drawing_id, contour_id, CAST(least(floor((ori + 11.25) % 180 / 22.5), 7) AS INTEGER) AS bin, sum(len) AS v FROM feat GROUP BY ALL),
sc AS (SELECT h.drawing_id, h.contour_id, sum(CASE WHEN clen > 0 THEN v / clen * 10000 ELSE 0 END * {_WEIGHTS}[bin + 1]) AS score FROM h JOIN cont USING (drawing_id, contour_id) GROUP BY ALL),
r AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM sc WINDOW w AS (PARTITION BY drawing_id))
SELECT drawing_id, contour_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END, 4) + 0.0 AS level FROM r""",
)
def score_levels(spark, sf):
    """What a drawing by scores is coloured with."""
    scores = split.histogram_score(stats.orientation_stats(featured(spark, sf)), _WEIGHTS)
    return stats.normalised_scores(scores).select(*geo.CONTOUR, "level")
