"""Intermediate tables in the folder that the cluster shares, which end a lineage, and what is shared with tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any
from weakref import WeakKeyDictionary

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from strokeframe.tables import shared_folder

#: Where each table of written() lies.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths and broadcasts made in each open scope().
_scopes: list[tuple[list[str], list[Broadcast]]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a lost executor costs one task, not the lineage.
    With ``keep`` it outlasts the scope."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    if _scopes and not keep:
        _scopes[-1][0].append(path)
    return back


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Deletes a table of written() that nothing will read any more."""
    if table in _paths:
        _delete(table.sparkSession, _paths.pop(table))


def shared(spark: SparkSession, value: Any) -> Broadcast:
    """``value`` broadcast to the tasks, until the scope ends."""
    made = spark.sparkContext.broadcast(value)
    if _scopes:
        _scopes[-1][1].append(made)
    return made


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables of written() and the broadcasts of shared() that were made within it, but for
    the tables that are to be kept. Scopes are of one thread."""
    tables, broadcasts = made = ([], [])
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in tables:
            _delete(spark, path)
        for b in broadcasts:
            b.destroy()
