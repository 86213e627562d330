"""Sets of drawings by category: Parquet or array files in folders ``category=...``, and the table of their histograms."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeframe.operators import geometry, junctions, stats
from strokeframe.tables import written

#: Fixed values of the array file format: its first bytes, and the bytes of the header's length by major version.
MAGIC, LENGTH_BYTES = b"\x93NUMPY", {1: 2, 2: 4, 3: 4}
#: The types of junctions that a scene table counts.
JUNCTION_TYPES = ["Arrow", "T", "X", "Y"]
SEGMENTS = "category string, image_name string, contour_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double"


def parse_array(data: bytes) -> np.ndarray:
    """The array of numbers in a file's bytes. ValueError if these are no such file, are cut short, or hold objects, which are
    programs rather than data and are not read."""
    if data[:6] != MAGIC or len(data) < 10 or data[6] not in LENGTH_BYTES:
        raise ValueError("no array file")
    start = 8 + LENGTH_BYTES[data[6]]
    end = start + int.from_bytes(data[8:start], "little")
    try:
        head = ast.literal_eval(data[start:end].decode("latin1"))
        dtype, shape = np.dtype(head["descr"]), tuple(head["shape"])
    except (SyntaxError, KeyError, TypeError) as error:
        raise ValueError("no array header") from error
    if dtype.hasobject:
        raise ValueError("an array of objects")
    count = int(np.prod(shape, dtype=np.int64))
    if len(data) - end < count * dtype.itemsize:
        raise ValueError("an array that is cut short")
    return np.frombuffer(data, dtype, count, end).reshape(shape, order="F" if head["fortran_order"] else "C")


def write_scenes(drawings: DataFrame, folder: str) -> None:
    """Segments (category, image_name, contour_id, seg_id, x1, y1, x2, y2) as Parquet, a folder for each category."""
    drawings.repartition("category", F.pmod(F.xxhash64("image_name"), F.lit(16))).write.partitionBy("category").parquet(folder)


def read_scenes(spark: SparkSession, folder: str, categories: list[str] | None = None) -> DataFrame:
    """What write_scenes() has written; of ``categories`` only their folders are read."""
    found = spark.read.schema(SEGMENTS).parquet(folder)
    found = found if categories is None else found.where(F.col("category").isin(*categories))
    return found.select(*[c.split()[0] for c in SEGMENTS.split(", ")])


def read_scene_arrays(spark: SparkSession, folder: str, categories: list[str] | None = None) -> DataFrame:
    """(category, image_name, contour_id, seg_id, x1, y1, x2, y2) from array files ``category=.../<image_name>.npy`` of five columns:
    contour, x1, y1, x2, y2, a contour's segments in order. A file is read by one task, as bytes; folders of other
    categories are not read. A file with anything else fails the job with its path.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    files = files if categories is None else files.where(F.col("category").isin(*categories))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.npy$", "")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for category, image, path, content in zip(*(b.column(c).to_pylist() for c in ("category", "image_name", "path", "content")), strict=True):
                try:
                    a = parse_array(content).astype(np.float64)
                    if a.ndim != 2 or a.shape[1] != 5:
                        raise ValueError(f"an array of shape {a.shape}")
                except ValueError as error:
                    raise ValueError(f"{path}: {error}") from error
                contour = a[:, 0].astype(np.int64)
                order = np.argsort(contour, kind="stable")
                contour, a = contour[order], a[order]
                seg = np.arange(len(a)) - np.searchsorted(contour, contour)
                yield pa.RecordBatch.from_arrays([pa.array([category] * len(a), pa.string()), pa.array([image] * len(a), pa.string()), pa.array(contour), pa.array(seg), *[pa.array(a[:, k]) for k in range(1, 5)]], [c.split()[0] for c in SEGMENTS.split(", ")])

    return files.select(F.col("category").cast("string").alias("category"), name.alias("image_name"), "path", "content").mapInArrow(parse, SEGMENTS)


def scene_results(scenes: DataFrame, bins: int = 8) -> DataFrame:
    """(category, image_name, ori_1 ..., horver_1 ..., len_1 ..., curv_1 ..., junc_Arrow, ...): a row for each scene with its
    histograms, per 10000 of length. Lengths and curvatures are binned between the least and the greatest of all scenes;
    junctions are merged ones of JUNCTION_TYPES.
    """
    named = written(scenes.withColumn("drawing_id", F.xxhash64("category", "image_name")), "scenes")
    seg = written(geometry.with_properties(named.drop("category", "image_name")), "scene-segments")
    lengths = geometry.contour_lengths(seg)
    # two pairs of numbers
    span = {r["property"]: (r["low"], r["high"]) for r in stats.property_ranges(seg, ["curv"]).unionByName(stats.property_ranges(lengths, ["clen"])).collect()}
    ends = {k: (lo, hi if hi > lo else lo + 1) for k, (lo, hi) in ({"curv": (0.0, 90.0), "clen": (0.0, 1.0)} | span).items()}
    length = stats.weighted_histogram(lengths, stats.log_bin(F.col("clen"), *ends["clen"], bins), F.col("clen"), lengths)
    names = list(range(bins))
    parts = {
        "ori": (stats.orientation_stats(seg, bins), names), "horver": (stats.horizontal_vertical_stats(seg, bins), names), "len": (length, names),
        "curv": (stats.curvature_stats(seg, bins, *ends["curv"]), names),
    }
    table = stats.scene_table(named.select("drawing_id", "category", "image_name").distinct(), parts)
    whole = lengths.groupBy("drawing_id").agg(F.sum("clen").alias("whole"))
    counts = junctions.type_counts(junctions.compute(seg)).join(whole, "drawing_id").withColumn("norm_value", F.col("n") / F.col("whole") * 10000)
    wide = stats.wide_table(counts.withColumnRenamed("type", "bin"), "junc", JUNCTION_TYPES)
    return table.join(wide, "drawing_id", "left").fillna(0.0, wide.columns[1:]).drop("drawing_id")


def save_scene_table(scenes: DataFrame, path: str) -> DataFrame:
    """scene_results() as CSV files with a header, in the order of category and name; gives the table as it was written."""
    table = written(scene_results(scenes), "scene-table")
    table.repartitionByRange(F.col("category"), F.col("image_name")).sortWithinPartitions("category", "image_name").write.option("header", True).csv(path)
    return table
