"""Vectors that take part in a search, and equal vectors as one class, so that a group of copies is one candidate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stands for a null id within classes: the last among equal scores.
NO_ID = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; false for a null vector."""
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(real, F.lit(False))


def class_key(*parts: Column) -> Column:
    """A text of 128 bits that tells classes apart."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in ("one", "two")])


def classes(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(``key``, ``ids``, *``keys``) of each distinct value of ``keys`` among ``rows`` (id, *keys): the smallest ``most`` ids.

    Each input partition sends at most ``most`` rows of a value, so copies by the million are no hot key.
    """
    least = W.partitionBy(*keys).orderBy("id")
    kept = rows.withColumn("id", F.coalesce("id", F.lit(NO_ID))).withColumn("_place", F.row_number().over(least)).where(F.col("_place") <= most)
    grouped = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return grouped.select(class_key(*keys).alias("key"), "ids", *keys)


def without_own(found: Column, own: Column) -> Column:
    """An array without the first element for which ``own`` (an array of booleans beside it) is true."""
    at = F.coalesce(F.array_position(own, True), F.lit(0)).cast("int")
    rest = F.concat(F.slice(found, 1, F.greatest(at - 1, F.lit(0))), F.slice(found, at + 1, F.size(found)))
    return F.when(at > 0, rest).otherwise(found)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """float64 rows of a list column; shorter lists are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def ranges(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column of whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]
