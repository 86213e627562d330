"""From documents to token statistics in five stages, each on all that the one before it kept.

1. quality: rejects documents by nearest-neighbour voting among labelled rows
2. language: rejects documents without a clear language
3. near_dup: one document of each group of near duplicates stays
4. decontamination: documents with benchmark passages go
5. sentencepiece: the rest is encoded, and decoded again as a check

Null and empty texts: quality rejects them, as they score 0.5. A null doc_id is a document of
its own for near_dup, which keeps it, while decontamination takes all rows without doc_id, or with the same, as one.
Repeated rows: quality and language judge each; near_dup keeps all rows of the doc_id that stays. Texts of any length
are taken whole. Ties: of equal documents the one with the least doc_id stays. Columns beyond those of documents,
whatever their names, pass through the first four stages. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeframe.llm import decontaminate, lang_id, near_dup, quality, sentencepiece_codec
from strokeframe.llm.queries import LANG_ROWS, QUALITY_ROWS
from strokeframe.llm.store import discard, scope, written
from strokeframe.llm.training import labelled_texts, remainder
from strokeframe.tables import read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return quality.accepted(docs, quality.fit(labelled_texts(docs, labels, "quality", 4, 2, QUALITY_ROWS)))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.fit(docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id"), 4) != 2), "lang", LANG_ROWS)
    return lang_id.accepted(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs, 5, 80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), 13)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(docs, sentencepiece_codec.read_model(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_dup", keep_one_of_near_duplicates),
    ("decontamination", keep_uncontaminated),
    ("sentencepiece", tokenize),
]

#: No stage but decontamination can be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's are written to the shared folder and read again. A stage's own
    tables and broadcasts, and its predecessor's rows, go as soon as its rows are written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            kept = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
