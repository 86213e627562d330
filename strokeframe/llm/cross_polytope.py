"""Approximate nearest neighbours by cross-polytope hashing (Andoni and others 2015).

Vectors become unit vectors; each of several tables rotates them by random signs and Hadamard transforms, three times
in turn, and takes the nearest signed axis as the bucket. A query probes, in each table, the buckets whose axes are nearest to its own
rotated vector, and all rows of those are ranked by exact inner products. How many buckets that takes for the wanted
recall is measured against brute force, on a bounded sample of the queries and all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .store import written
from .vectors import NO_ID, class_key, classes, finite, matrix, ranges, without_own

#: Tables; sample of queries that settles the probes (at most so many), and the recall it has to reach.
TABLES, SAMPLE, RECALL = 8, 256, 0.95
#: Rows for each bucket beyond which a second rotation splits the buckets.
DENSE = 1 << 17
#: Rows and queries of a bucket that are compared in one group.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024

_ROUND = 1e-12  # a matrix product's rounding, relative to the lengths


@dataclass(frozen=True)
class Hashes:
    """The hash tables' parameters: the vectors' width and greatest length, whether lengths differ, and rotations."""

    width: int
    longest: float
    uneven: bool
    rotations: int

    @property
    def axes(self) -> int:
        """Coordinates after filling up to a power of two, with one more for the lengths if they differ."""
        return 1 << max(0, self.width + self.uneven - 1).bit_length()

    def signs(self) -> np.ndarray:
        """(table, rotation, 3, axes) of random signs, the same everywhere."""
        return np.random.default_rng(13).choice([-1.0, 1.0], (TABLES, self.rotations, 3, self.axes))

    def units(self, x: np.ndarray, stored: bool) -> np.ndarray:
        """Unit vectors whose inner products are in proportion to those of a query with the rows: a stored row is
        divided by the greatest length, and what is missing goes into a coordinate where a query has 0."""
        out = np.zeros((len(x), self.axes))
        length = np.sqrt((x * x).sum(axis=1))
        if not stored or not self.uneven:
            out[:, : self.width] = x / length[:, None]
        else:
            out[:, : self.width] = x / self.longest
            out[:, self.width] = np.sqrt(np.maximum(0, 1 - (length / self.longest) ** 2))
        return out

    def rotated(self, units: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            units = hadamard(units * s)
        return units

    def codes(self, units: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each row in each table."""
        out = np.zeros((len(units), TABLES), np.int64)
        for t in range(TABLES):
            for r in range(self.rotations):
                y = self.rotated(units, signs[t, r])
                axis = np.abs(y).argmax(axis=1)
                out[:, t] = out[:, t] * 2 * self.axes + 2 * axis + (y[np.arange(len(y)), axis] > 0)
        return out

    def values(self, units: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """(rows, buckets): how near each bucket's axes are, for one table's signs."""
        out = np.zeros((len(units), 1))
        for r in range(self.rotations):
            y = self.rotated(units, signs[r])
            both = np.stack([-y, y], axis=2).reshape(len(y), 1, -1)
            out = (out[:, :, None] + both).reshape(len(y), -1)
        return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, which keeps lengths."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def exact_top(q: np.ndarray, x: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``k`` best rows by (score down, tie up); a pair's score depends on its vectors alone."""
    s = q @ x.T
    slack = _ROUND * np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1).max(initial=0))
    kth = np.partition(s, len(x) - k, axis=1)[:, len(x) - k][:, None] if len(x) > k else np.full((len(q), 1), -np.inf)
    at, row = np.nonzero(s >= kth - slack)
    score = (q[at] * x[row]).sum(axis=1)
    order = np.lexsort((tie[row], -score, at))
    at, row, score = at[order], row[order], score[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], row[rank < k], score[rank < k]


def _probes(spark: SparkSession, stored: DataFrame, asked: DataFrame, h: Hashes, signs: np.ndarray, k: int) -> int:
    """The least number of buckets to each table with which a sample of the queries finds RECALL of its neighbours."""
    sample = asked.orderBy("key").limit(SAMPLE).select("key", "vector").toArrow()  # at most SAMPLE rows
    q = matrix(sample.column("vector"), h.width)
    if not len(q):
        return 1
    names = np.array(sample.column("key").to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"), h.width)
            # one more than asked for: the query's own row does not count
            at, row, score = exact_top(q, x, np.arange(len(x)), k + 1)
            code = h.codes(h.units(x[row], True), signs)
            own = np.array(b.column("key").to_pylist(), object)[row] == names[at]
            yield pa.record_batch({"at": pa.array(at), "score": pa.array(score), "own": pa.array(own, pa.bool_()), "codes": pa.array(list(code), pa.list_(pa.int64()))})

    near = stored.select("key", "vector").mapInArrow(run, "at bigint, score double, own boolean, codes array<bigint>").where("NOT own")
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("at").orderBy(F.col("score").desc()))).where(F.col("rank") <= k)
    found = best.select("at", "codes").toArrow()  # at most SAMPLE x k rows
    at, code = found.column("at").to_numpy(), np.array(found.column("codes").to_pylist(), np.int64).reshape(-1, TABLES)
    if not len(at):
        return 1
    first = np.full(len(at), np.iinfo(np.int64).max)  # of the tables, the least number of probes that reaches the neighbour
    units = h.units(q, False)
    for t in range(TABLES):
        value = h.values(units, signs[t])
        reached = value[at, code[:, t]]
        first = np.minimum(first, [(value[a] >= r).sum() for a, r in zip(at, reached, strict=True)])
    return int(np.sort(first)[min(len(first) - 1, int(np.ceil(RECALL * len(first))) - 1)])


def _compare(width: int, k: int):
    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        """The best ``k`` rows, from one block of a bucket, for each query of a block that probes it."""
        x, q = matrix(stored.column("vector"), width), matrix(asked.column("vector"), width)
        ids, off = ranges(stored.column("ids"))
        keys, names = stored.column("key").combine_chunks(), asked.column("query").combine_chunks()
        out = []
        for i in range(0, max(len(q), 1), 256):
            at, row, score = exact_top(q[i : i + 256], x, ids[off[:-1]], k) if len(x) else (np.zeros(0, np.int64),) * 3
            # a class stands for its smallest ids
            many = off[row + 1] - off[row]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at, row, score = np.repeat(at, many), np.repeat(row, many), np.repeat(score, many)
            got = ids[off[row] + nth]
            order = np.lexsort((got, -score, at))
            at, row, score, got, nth = at[order], row[order], score[order], got[order], nth[order]
            kept = np.arange(len(at)) - np.searchsorted(at, at) < k
            out.append(pa.table({
                "query": names.take(pa.array(at[kept] + i)), "key": keys.take(pa.array(row[kept])), "nth": pa.array(nth[kept], pa.int32()),
                "id": pa.array(got[kept], pa.int64()), "score": pa.array(score[kept], pa.float64()),
            }))
        return pa.concat_tables(out)

    return run


def nearest(rows: DataFrame, asks: str, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found with the largest inner product, for each of ``rows``
    (vec_id, embedding) that fulfils the condition ``asks`` on vec_id. All rows are candidates but a query's own.

    Scores are inner products in double precision, nearest first, ties to the smaller vec_id, null last. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part; a shorter vector counts as filled up with zeros. Rows that
    repeat a vec_id are rows of their own: each asks, and each is found. Equal vectors are one class that is searched
    for once and stands for its smallest ids; a row without vec_id asks nothing; 2^63 - 1 stands for a null vec_id. Buckets and queries of any number go
    through blocks; nothing is capped. Other columns take no part. An empty table gives no rows.
    """
    spark = rows.sparkSession
    real = rows.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("vector")).where(finite(F.col("embedding").cast("array<double>")))
    real = real.where(_length("vector") > 0)
    stored = written(classes(real, ["vector"], k + 1), "ann-classes")
    wants = real.where(F.expr(asks.replace("vec_id", "id")))
    asked = written(wants.select("vector").distinct().select(class_key(F.col("vector")).alias("key"), "vector"), "ann-queries")
    n, width, longest, shortest = stored.select(F.size("vector").alias("w"), _length("vector").alias("length")).agg(F.count(F.lit(1)), F.max("w"), F.max("length"), F.min("length")).first()
    h = Hashes(width or 1, longest or 1.0, (shortest or 1.0) < (longest or 1.0) * (1 - 1e-6), 1)
    if (n or 0) > DENSE * 2 * h.axes:
        h = Hashes(h.width, h.longest, h.uneven, 2)
    signs = h.signs()
    probes = _probes(spark, stored, asked, h, signs, k)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = h.codes(h.units(matrix(b.column("vector"), h.width), True), signs)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(code), pa.list_(pa.int64()))], [*b.schema.names, "codes"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                units = h.units(matrix(part.column("vector"), h.width), False)
                best = []
                for t in range(TABLES):
                    value = h.values(units, signs[t])
                    best.append(np.argpartition(-value, min(probes, value.shape[1]) - 1, axis=1)[:, :probes] if probes < value.shape[1] else np.tile(np.arange(value.shape[1]), (len(units), 1)))
                flat = np.stack(best, axis=1).reshape(len(units), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(flat), pa.list_(pa.int64()))], [*part.schema.names, "codes"])

    each = stored.mapInArrow(hashed, _with_codes(stored)).select("key", "ids", "vector", F.posexplode("codes").alias("table", "bucket"))
    probe = asked.mapInArrow(probing, _with_codes(asked))
    per = F.lit(max(1, min(probes, (2 * h.axes) ** h.rotations)))
    probe = probe.select(F.col("key").alias("query"), "vector", F.posexplode("codes").alias("place", "bucket")).withColumn("table", F.floor(F.col("place") / per).cast("int"))
    each, probe = written(each, "ann-buckets"), written(probe.drop("place"), "ann-probes")
    # at most TABLES x buckets rows of four integers
    row_blocks = each.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("row_blocks"))
    query_blocks = probe.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    blocks = F.broadcast(row_blocks.join(query_blocks, ["table", "bucket"]))
    rows_in = each.join(blocks, ["table", "bucket"]).select(
        "table", "bucket", F.pmod(F.xxhash64("key"), F.col("row_blocks")).cast("int").alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("q"), "key", "ids", "vector",
    )
    queries_in = probe.join(blocks, ["table", "bucket"]).select(
        "table", "bucket", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("r"),
        F.pmod(F.xxhash64("query"), F.col("query_blocks")).cast("int").alias("q"), "query", "vector",
    )
    group = ["table", "bucket", "r", "q"]
    compare = _compare(h.width, k + 1)
    found = rows_in.groupBy(*group).cogroup(queries_in.groupBy(*group)).applyInArrow(compare, "query string, key string, nth int, id bigint, score double")
    best = W.partitionBy("query").orderBy(F.col("score").desc(), "id", "key", "nth")
    # a row is found once in each table at most, so this many hold the best k + 1
    few = found.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= (k + 1) * TABLES)
    few = few.groupBy("query", "key", "nth").agg(F.first("id").alias("id"), F.first("score").alias("score"))
    few = few.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k + 1)
    each_query = few.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_place", "key", "id", "score"))).alias("found"))
    each_query = written(each_query, "ann-found")
    own = F.transform("found", lambda x: (x["key"] == F.col("key")) & (x["id"] == F.col("query_id")))
    asking = wants.select(F.col("id").alias("query_id"), class_key(F.col("vector")).alias("key"))
    out = asking.join(each_query.withColumnRenamed("query", "key"), "key").select("query_id", F.slice(without_own(F.col("found"), own), 1, k).alias("found"))
    out = out.select("query_id", F.posexplode("found").alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.nullif(F.col("x.id"), F.lit(NO_ID)).alias("vec_id"), "x.score")


def _with_codes(table: DataFrame) -> StructType:
    return StructType([*table.schema.fields, StructField("codes", ArrayType(LongType()))])


def _length(column: str) -> Column:
    return F.sqrt(F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
