"""Labelled training rows: the held-out rule, bounded samples, and models fitted in a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sample, whatever the number of labels; labels up to which their counts are broadcast.
MOST_ROWS, FEW_LABELS = 20_000, 100_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def bounded_sample(labelled: DataFrame, label: str, per_label: int, key: str = "doc_id", most: int = MOST_ROWS) -> DataFrame:
    """About ``per_label`` rows of each label (null: none), and about ``most`` in all, chosen by a hash of ``key``:
    the same rows in every run. Only the number of labels comes to the driver."""
    known = labelled.where(F.col(label).isNotNull())
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    labels = counts.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
    rate = F.lit(float(min(per_label, most / max(labels, 1)))) / F.col("_rows")
    counted = known.join(F.broadcast(counts) if labels <= FEW_LABELS else counts, label)
    return counted.where(place < rate).select(*labelled.columns)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_label: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of the labelled documents that are not held out."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(remainder(F.col("doc_id"), modulus) != held_out)
    ids = bounded_sample(ids.where("label IN (0, 1)").distinct(), "label", per_label)
    # at most about 2 * per_label rows of two integers
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fitted(rows: DataFrame, train: Callable[[pa.Table], Any]) -> Any:
    """What ``train`` makes of all ``rows``, a bounded sample, in one task: only the model comes to the driver."""
    schema = rows.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        yield pa.record_batch({"model": pa.array([pickle.dumps(train(table), 5)], pa.binary())})

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found is not None else train(schema.empty_table())
