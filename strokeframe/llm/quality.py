"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its hashed byte trigrams, the grams of its shape (bytes by kind: upper or lower case, digit, beyond
ASCII; a mark stands for itself), and the grams of its repetitions (how many words ago each word last occurred).
Log counts times inverse document frequencies make three blocks of unit length; the latent space is the truncated singular
value decomposition of the sampled training rows. Their vectors and labels are broadcast - the bound is a parameter - and
every text's exact cosine with each of them is a blocked matrix product; the nearest vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .flat import Words, gram_counts, slices, text_bytes
from .names import others
from .store import shared
from .training import fitted

RANK, NEIGHBOURS, SHARPNESS = 64, 15, 8
#: Hash bits of the three blocks of terms: trigrams, shapes, repetitions.
BITS = (11, 11, 8)
WIDTHS = [1 << b for b in BITS]
#: The score from which a text is of good quality.
ACCEPTED = 0.7
#: Vectors are rounded to this part of one, so that their products are exact and equal texts score alike.
GRAIN = 2.0**-20
#: Bytes and rows of texts that are worked on at once.
BLOCK, ROWS = 1 << 20, 512
#: Rounds of the subspace iteration, and directions beyond RANK that it carries.
ROUNDS, SPARE = 6, 16


def _shapes() -> np.ndarray:
    """What stands for each byte in a text's shape."""
    shape = np.arange(256, dtype=np.uint8)  # a mark stands for itself
    for k, kind in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), range(0x80, 0x100), b" \t\n\r\v\f"), 1):
        shape[list(kind)] = k
    return shape


_SHAPES = _shapes()


def repetitions(w: Words) -> np.ndarray:
    """Of each word, one byte: 0 if it is new in its text, else a step that grows as the logarithm of the words since it last occurred."""
    order = np.argsort(w.hashes, kind="stable")
    last = np.full(len(order), -1)
    again = w.hashes[order[1:]] == w.hashes[order[:-1]]
    last[order[1:][again]] = order[:-1][again]
    since = np.arange(len(order)) - last
    step = np.minimum(np.log2(np.maximum(since, 1)).astype(np.uint8) + 1, 7)
    return np.where(last < np.repeat(w.bounds[:-1], w.counts()), 0, step).astype(np.uint8)


def raw_features(column: pa.Array) -> np.ndarray:
    """float32 (texts, sum of WIDTHS): log counts of trigrams, of grams of 3 and 4 shapes, and of 1 to 3 repetitions."""
    raw, off = text_bytes(column)
    w = Words(column, lower=False)
    blocks = (gram_counts(raw, off, (3,), BITS[0]), gram_counts(_SHAPES[raw], off, (3, 4), BITS[1]), gram_counts(repetitions(w), w.bounds, (1, 2, 3), BITS[2]))
    return np.log1p(np.concatenate(blocks, axis=1))


@dataclass
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray  # (terms, RANK)
    vectors: np.ndarray  # (labelled rows, RANK), unit length
    labels: np.ndarray
    weights: np.ndarray  # of each labelled row's vote

    def embed(self, features: np.ndarray) -> np.ndarray:
        return unit(weighted(features, self.idf).astype(np.float64) @ self.axes)

    def votes(self, column: pa.Array, block: int = 256) -> np.ndarray:
        """The weighted share of label 1 among the nearest labelled rows; 0.5 where there are none, or the text has no terms.

        Of rows that are equally near the first by doc_id vote.
        """
        x = self.embed(raw_features(column))
        out = np.full(len(x), 0.5)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for i in range(0, len(x), block):
            cosine = x[i : i + block] @ self.vectors.T
            least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            above, level = cosine > least, cosine == least
            votes = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
            near = np.nonzero(votes)[1].reshape(-1, k)
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3) ** SHARPNESS * self.weights[near]
            out[i : i + block] = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        out[~x.any(axis=1)] = 0.5
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, float64 in steps of GRAIN."""
    return np.rint(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) / GRAIN) * GRAIN


def weighted(features: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each block at unit length (or zero, if it has no terms)."""
    parts, cuts = [], np.cumsum(WIDTHS)[:-1]
    for x in np.split(features * idf, cuts, axis=1):
        parts.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))
    return np.concatenate(parts, axis=1)


def latent_axes(w: np.ndarray) -> np.ndarray:
    """The first RANK right singular vectors of ``w``, by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).normal(size=(w.shape[1], min(RANK + SPARE, w.shape[1])))
    for _ in range(ROUNDS):
        q = np.linalg.qr(w.T @ (w @ q))[0]
    _, _, turn = np.linalg.svd(w @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turn.T)[:, :RANK])


def train(rows: pa.Table) -> QualityModel:
    """rows: (doc_id, label, x) with x the float16 features."""
    rows = rows.sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(-1, sum(WIDTHS)).astype(np.float32)
    y = np.asarray(rows["label"].to_pylist(), np.float64)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    axes = latent_axes(weighted(x, idf)) if len(x) else np.zeros((sum(WIDTHS), RANK))
    # both labels weigh the same in all, and equal votes of both give the score ACCEPTED
    weights = np.where(y == 1, ACCEPTED / (1 - ACCEPTED) / max((y == 1).sum(), 1), 1 / max((y == 0).sum(), 1)) * len(y) / 2
    model = QualityModel(idf, axes, np.zeros((0, RANK)), y, weights)
    if len(x):
        model.vectors = np.concatenate([model.embed(x[i : i + ROWS]) for i in range(0, len(x), ROWS)])
    return model


def fit(sample: DataFrame) -> QualityModel:
    """sample: a bounded set of (doc_id, text, label); the model is made in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK, ROWS):
            x = raw_features(b.column("text")).astype(np.float16)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "label": b.column("label"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return fitted(sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, label int, x binary"), train)


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) to ``docs``; all columns stay (one named score, in any case, is replaced).

    Null and empty texts have no terms and score 0.5, as all do without labelled rows.
    """
    held = shared(docs.sparkSession, model)
    names = others(docs.columns, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, text, BLOCK, ROWS):
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(m.votes(b.column(text)).astype(np.float64))], [*names, "score"])

    return docs.select(*names).mapInArrow(run, docs.select(*names).schema.add("score", "double"))


def accepted(docs: DataFrame, model: QualityModel, least: float = ACCEPTED, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, with their columns as they are."""
    held = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, BLOCK, ROWS):
            yield b.filter(pa.array(held.value.votes(b.column(text)) >= least))

    return docs.mapInArrow(run, docs.schema)
