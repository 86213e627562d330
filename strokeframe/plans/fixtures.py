"""Line drawings, rasters and descriptors as views over the driver's tables (FIXTURES.md B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeframe.operators.raster import edges
from strokeframe.tables import read_table

WIDTH, HEIGHT = 640, 480
RASTER_H, RASTER_W = 32, 48


def points(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(drawing_id, contour_id, pt, x, y): one polyline vertex for each line item.

    Line items are dealt out by drawing once, which is enough for all that is worked out within contours and drawings; ``dealt``: to a
    stated number of partitions, for work that is not in the bytes by which adaptive plans join partitions.
    """
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    q = F.col("l_quantity").cast("int")
    rows = read_table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 75").alias("drawing_id"), "l_orderkey", *order)
    parts = [int(spark.conf.get("spark.sql.shuffle.partitions"))] if dealt else []
    return rows.repartition(*parts, "drawing_id").select(
        "drawing_id", F.col("l_orderkey").alias("contour_id"),
        (F.row_number().over(W.partitionBy("drawing_id", "l_orderkey").orderBy(*order)) - 1).cast("bigint").alias("pt"),
        ((F.col("l_partkey") * 7 + q * 13) % WIDTH).cast("double").alias("x"),
        ((F.col("l_suppkey") * 31 + F.col("l_linenumber") * 17 + q * 5) % HEIGHT).cast("double").alias("y"),
    )


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drawing_id, contour_id, pt, x, y, r): the vertices of each contour as a branch, with radii made of their places."""
    return points(spark, sf_dir).withColumn("r", ((F.col("x") * 3 + F.col("y") * 5) % 17 + 3) / 4)


def segments(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(drawing_id, contour_id, seg_id, x1, y1, x2, y2): consecutive vertices; ``dealt`` as of points()."""
    w = W.partitionBy("drawing_id", "contour_id").orderBy("pt")
    return points(spark, sf_dir, dealt).select(
        "drawing_id", "contour_id", F.col("pt").alias("seg_id"), F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"),
    ).where("x2 IS NOT NULL")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drawing_id, n): the vertices of each drawing."""
    return read_table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 75").alias("drawing_id")).agg(F.count(F.lit(1)).alias("n"))


def raw_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raster_id, y, x, strength): sparse rasters of 32 rows and 48 columns, of all line items."""
    q = F.col("l_quantity").cast("int")
    return read_table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("raster_id"), ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 5) % RASTER_H).alias("y"),
        ((F.col("l_partkey") * 11 + q * 3) % RASTER_W).alias("x"),
    ).agg((F.max("l_quantity") / 50.0).alias("strength"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raster_id, y, x, strength): the edges among the raw pixels, those of half strength or more."""
    return edges(raw_pixels(spark, sf_dir), 0.5)


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_idx, vec): unit vectors."""
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_idx"), F.col("embedding").cast("array<double>").alias("vec"))


#: The same views in DuckDB SQL, as the head of an oracle query.
SQL = """WITH points AS (
  SELECT l_orderkey // 75 AS drawing_id, l_orderkey AS contour_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pt,
    CAST((l_partkey * 7 + CAST(l_quantity AS INT) * 13) % 640 AS DOUBLE) AS x,
    CAST((l_suppkey * 31 + l_linenumber * 17 + CAST(l_quantity AS INT) * 5) % 480 AS DOUBLE) AS y
  FROM lineitem),
seg AS (SELECT * FROM (
  SELECT drawing_id, contour_id, pt AS seg_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
  FROM points WINDOW w AS (PARTITION BY contour_id ORDER BY pt)) WHERE x2 IS NOT NULL),
feat0 AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len,
  (degrees(atan2(trunc(y1) - trunc(y2), trunc(x2) - trunc(x1))) + 360) % 360 AS ori FROM seg),
feat1 AS (SELECT *, abs(ori - coalesce(lead(ori) OVER w, lag(ori) OVER w)) AS turn FROM feat0
  WINDOW w AS (PARTITION BY contour_id ORDER BY seg_id)),
feat AS (SELECT * EXCLUDE (turn), coalesce(CASE WHEN turn > 180 THEN 360 - turn ELSE turn END / (len + 1e-10), 0) AS curv FROM feat1),
cont AS (SELECT drawing_id, contour_id, sum(len) AS clen FROM feat GROUP BY ALL),
branch AS (SELECT *, ((x * 3 + y * 5) % 17 + 3) / 4 AS r FROM points),
deriv0 AS (SELECT *, avg(r) OVER (PARTITION BY contour_id ORDER BY pt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rs FROM branch),
deriv AS (SELECT *, coalesce(lead(x) OVER w - x, x - lag(x) OVER w, 0) AS dx, coalesce(lead(y) OVER w - y, y - lag(y) OVER w, 0) AS dy,
  coalesce(lead(rs) OVER w - rs, rs - lag(rs) OVER w, 0) AS dr FROM deriv0 WINDOW w AS (PARTITION BY contour_id ORDER BY pt)),
raw_pix AS (
  SELECT l_suppkey AS raster_id, (l_partkey * 7 + l_linenumber * 5) % 32 AS y,
    (l_partkey * 11 + CAST(l_quantity AS INT) * 3) % 48 AS x, max(l_quantity) / 50.0 AS strength
  FROM lineitem GROUP BY 1, 2, 3),
pix AS (SELECT * FROM raw_pix WHERE strength >= 0.5),
vecs AS (SELECT vec_id AS image_idx, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec FROM embeddings)
"""
