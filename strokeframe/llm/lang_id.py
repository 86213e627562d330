"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (Joulin et al. 2016); embeddings and the
softmax are trained together by stochastic gradient descent in numpy. One class more stands for no language:
its examples are training texts with their characters shuffled. A temperature is fitted on rows kept apart, and
the rejection threshold is the quantile of their own language's probabilities at a stated rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import counted_rows, gram_counts, slices, text_bytes
from .names import fresh, others
from .store import shared
from .training import bounded_sample, fitted

BITS, SIZES, DIM = 13, (2, 3), 16
#: Bytes of text that are counted at once.
BLOCK = 1 << 20
UNDETERMINED = "und"
#: The class of shuffled texts; of one document in so many a shuffled piece is learned, and of each length of piece.
NONE, SHUFFLED, PIECES = "\0", 4, (40, 160)


@dataclass
class LangModel:
    langs: list[str]
    logits: np.ndarray  # (2^BITS, langs and NONE): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Of each language of ``langs`` for each text; what is missing to 1 is the probability of none."""
        return self.all_classes(column)[:, : len(self.langs)]

    def all_classes(self, column: pa.Array) -> np.ndarray:
        raw, off = text_bytes(column)
        counts = gram_counts(raw, off, SIZES, BITS)
        mean = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return softmax((mean @ self.logits + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(sample: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, at, share): gram counts of each sampled text, of short pieces of it (short texts are learned
    as well), and of shuffled pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK, counted_rows(BITS) // (1 + 2 * len(PIECES))):
            texts = b.column("text").to_pylist()
            ids, names = b.column("doc_id").to_pylist(), b.column("label").to_pylist()
            rows = [(i, n, t) for i, n, t in zip(ids, names, texts, strict=True) if t]
            pieces = [(i, n, t[len(t) * k // (len(PIECES) + 1) :][:size]) for i, n, t in rows for k, size in enumerate(PIECES, 1)]
            shuffled = [(i, NONE, "".join(np.random.default_rng(len(t)).permutation(list(t)))) for i, _, t in pieces if (i or 0) % SHUFFLED == 0 and len(t) > 8]
            rows += [r for r in pieces if r[2].strip()] + shuffled
            raw, off = text_bytes(pa.array([r[2] for r in rows], pa.string()))
            counts = gram_counts(raw, off, SIZES, BITS)
            at = [np.flatnonzero(c).astype(np.uint16) for c in counts]
            share = [(c[i] / max(c.sum(), 1)).astype(np.float32) for c, i in zip(counts, at, strict=True)]
            yield pa.record_batch({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.string()),
                "at": pa.array([x.tobytes() for x in at], pa.binary()), "share": pa.array([x.tobytes() for x in share], pa.binary()),
            })

    return sample.select("doc_id", "text", F.col(label).alias("label")).mapInArrow(run, "doc_id bigint, label string, at binary, share binary")


def train(rows: pa.Table, epochs: int = 5, rate: float = 1.0, reject_rate: float = 0.001, seed: int = 7) -> LangModel:
    """Fits the model to examples (doc_id, label, at, share); a fifth of the documents calibrates it."""
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("at", "ascending")])
    labels = rows["label"].to_pylist()
    langs = sorted(set(labels) - {NONE})
    if not langs:
        return LangModel([UNDETERMINED], np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    x = [(np.frombuffer(a, np.uint16), np.frombuffer(s, np.float32)) for a, s in zip(rows["at"].to_pylist(), rows["share"].to_pylist(), strict=True)]
    classes = {n: k for k, n in enumerate([*langs, NONE])}
    y = np.array([classes[n] for n in labels])
    apart = np.array([(i or 0) % 5 == 0 for i in rows["doc_id"].to_pylist()])
    if apart.all() or not apart.any():
        apart = np.zeros(len(labels), bool)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    fit = np.flatnonzero(~apart)
    steps, step, size = epochs * -(-len(fit) // 16), 0, 16
    for _ in range(epochs):
        rng.shuffle(fit)
        for start in range(0, len(fit), size):
            part = fit[start : start + size]
            lr = rate * (1 - step / steps)
            mean = np.stack([x[i][1] @ emb[x[i][0]] for i in part])
            error = softmax(mean @ w + bias)
            error[np.arange(len(part)), y[part]] -= 1
            back = error @ w.T
            w -= lr * mean.T @ error / len(part) * 8
            bias -= lr * error.mean(axis=0) * 0.1
            for k, i in enumerate(part):
                emb[x[i][0]] -= lr * 8 * x[i][1][:, None] * back[k]
            step += 1
    table = emb @ w
    hold = np.flatnonzero(apart) if apart.any() else np.arange(len(labels))
    z = np.stack([x[i][1] @ table[x[i][0]] for i in hold]) + bias
    right = (np.arange(len(hold)), y[hold])
    temperature = min(np.geomspace(0.05, 5, 60), key=lambda t: -np.log(np.maximum(softmax(z / t)[right], 1e-12)).mean())
    own = softmax(z / temperature)[right][y[hold] < len(langs)]
    return LangModel(langs, table.astype(np.float32), bias, float(temperature), float(np.quantile(own, reject_rate)) if len(own) else 0.0)


def fit(docs: DataFrame, lang: str = "lang", per_lang: int = 1200) -> LangModel:
    """Trains, in one task, on about ``per_lang`` rows of ``docs`` for each value of the column ``lang`` (null: not
    used), and on no more than training.MOST_ROWS in all."""
    return fitted(_examples(bounded_sample(docs, lang, per_lang), lang), train)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected to ``docs``; all columns stay (those of these names, in any case, are replaced).

    A text that is null or has no letter is ``und`` with score 0, and rejected. score is the calibrated
    probability of lang_pred; rejected, that it is below the model's threshold.
    """
    held = shared(docs.sparkSession, model)
    names = others(docs.columns, "lang_pred", "score", "rejected")
    [flag] = fresh(names, "_lettered")
    schema = docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, text, BLOCK, counted_rows(BITS)):
            p = m.probabilities(b.column(text))
            at = p.argmax(axis=1)
            best = p[np.arange(len(p)), at].astype(np.float64)
            lettered = np.asarray(b.column(flag))
            lang = [m.langs[k] if ok else UNDETERMINED for k, ok in zip(at, lettered, strict=True)]
            best[~lettered] = 0
            columns = [b.column(c) for c in names] + [pa.array(lang), pa.array(best), pa.array((best < m.reject_below) | ~lettered)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "rejected"])

    out = schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*names, has_letter(F.col(text)).alias(flag)).mapInArrow(run, out)


def accepted(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected (they have a letter, and a probability that is high
    enough), with their columns as they are."""
    held = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, BLOCK, counted_rows(BITS)):
            yield b.filter(pa.array(held.value.probabilities(b.column(text)).max(axis=1) >= held.value.reject_below))

    return docs.where(has_letter(F.col(text))).mapInArrow(run, docs.schema)
