"""Image folders, sequence listings and cached tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".bmp")
SEQUENCE = "filename string, tile_y int, tile_x int, ld_h int, ld_w int"
SEQUENCE_SIZED = "filename string, tile_y int, tile_x int, tile_size int, ld_h int, ld_w int"


def file_name(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


def numbered_by_name(files: DataFrame) -> DataFrame:
    """Adds ``image_idx``, from 0 in the order of ``filename`` (a listing is small beside its images)."""
    return files.withColumn("image_idx", (F.row_number().over(W.orderBy("filename")) - 1).cast("bigint"))


def list_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(image_idx, filename, path) of the image files of a folder, sorted by name; extensions in any case."""
    files = spark.read.format("binaryFile").load(folder).select("path", file_name().alias("filename"))
    kept = files.where(F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)).isin(*extensions))
    return numbered_by_name(kept).select("image_idx", "filename", "path")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, height, width, n_channels, data) of the images that can be decoded; others are left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder)
    return images.select(file_name("image.origin").alias("filename"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def first_existing(wanted: DataFrame, files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``wanted`` (filename) with ``photo``: the file of the same stem with the first of ``extensions`` that exists,
    else the file of that very name, else null."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    order = F.array(*[F.lit(e) for e in extensions])
    have = files.select(stem("filename").alias("stem"), F.col("filename").alias("photo"), F.array_position(order, F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))).alias("place")).where("place > 0")
    best = have.groupBy("stem").agg(F.min(F.struct("place", "photo")).alias("b"))
    same = files.select(F.col("filename"), F.col("filename").alias("same"))
    joined = wanted.withColumn("stem", stem("filename")).join(best, "stem", "left").join(same, "filename", "left")
    return joined.withColumn("photo", F.coalesce("b.photo", "same")).drop("stem", "b", "same")


def drawings_by_name(listing: DataFrame, drawings: DataFrame) -> DataFrame:
    """The rows of ``listing`` (filename, ...) with those of ``drawings`` (filename, ...) of the same file; a name
    without a drawing stays, with nulls."""
    return listing.join(drawings, "filename", "left")


def read_sequence(spark: SparkSession, path: str, sized: bool = False) -> DataFrame:
    """A headerless listing with ``step`` from 0; blank lines are skipped. ``sized`` has a tile_size column."""
    lines = spark.read.schema(SEQUENCE_SIZED if sized else SEQUENCE).option("wholeFile", False).csv(path)
    return lines.where("filename IS NOT NULL").withColumn("step", F.row_number().over(W.orderBy(F.monotonically_increasing_id())) - 1)


def write_sequence(path_rows: DataFrame, path: str) -> None:
    """Rows in the order of ``step`` as one headerless file (a path is small)."""
    columns = [c for c in ("filename", "tile_y", "tile_x", "tile_size", "ld_h", "ld_w") if c in path_rows.columns]
    path_rows.orderBy("step").select(*columns).coalesce(1).write.csv(path)


def cached(spark: SparkSession, folder: str, parameters: dict, files: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` kept as Parquet under ``folder`` by the parameters and the set of file names, and made anew when
    either changes."""
    names = files.select(F.sha2(F.col("filename"), 256).alias("h")).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("h")), F.sum(F.crc32(F.col("h").cast("binary")))).first()
    key = hashlib.sha256(json.dumps([parameters, list(names)], sort_keys=True, default=str).encode()).hexdigest()
    path = f"{folder}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)
