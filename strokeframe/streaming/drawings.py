"""New drawings as a stream: per-drawing statistics of files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeframe.operators.geometry import with_length, with_orientation
from strokeframe.operators.stats import orientation_bin
from strokeframe.sources.svg import parse_files


def svg_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Segment rows of each SVG file that arrives."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.svg").load(folder)
    return parse_files(files)


def orientation_histograms(segments: DataFrame, bins: int = 8) -> DataFrame:
    """(filename, bin, value): length by orientation, kept up to date as files arrive."""
    lines = segments.where("x1 IS NOT NULL").transform(with_length).transform(with_orientation)
    return lines.groupBy("filename", orientation_bin(bins).alias("bin")).agg(F.sum("len").alias("value"))
