"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of a hashed row for the word and one for its first bytes; filters of several
widths slide over the words, each keeps its maximum (Kim 2014), and a logistic layer reads the maxima.
Only buckets that enough training texts share have a row, so that no text is learned by its rare words;
the others are zero. Trained by Adagrad in numpy. Probabilities are calibrated, and the threshold is set, by language as
predicted from the text; scores are rescaled so that every language's threshold is 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import lang_id
from .flat import Words, counted_rows, range_hash, slices
from .names import others
from .store import shared
from .training import fitted

#: Hash buckets of words and of stems (the first STEM bytes), and the training texts that a trained bucket is in.
BITS, STEM, SHARED_BY, DIM = 24, 4, 8, 8
WIDTHS, FILTERS = (1, 2, 3), 6
THRESHOLD = 0.7


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, stem buckets, bounds) of the words of each text."""
    w = Words(column, punctuation=True)
    stems = range_hash(w.raw, w.starts, np.minimum(w.ends, w.starts + STEM))
    shift = np.uint64(64 - BITS)
    return (w.hashes >> shift).astype(np.int32), (stems >> shift).astype(np.int32), w.bounds


def shared_buckets(texts: list[np.ndarray], least: int) -> np.ndarray:
    """The buckets that are in ``least`` texts or more, in order."""
    found, counts = np.unique(np.concatenate([np.unique(x) for x in texts] or [np.zeros(0, np.int32)]), return_counts=True)
    return found[counts >= least]


class Net:
    """Embeddings, filters and the logistic layer; the last row of each embedding table is zero."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], least: int = SHARED_BY, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.word_keys, self.stem_keys = (shared_buckets([d[k] for d in docs], least) for k in (0, 1))
        self.word = rng.normal(0, 0.05, (len(self.word_keys) + 1, DIM)).astype(np.float32)
        self.stem = rng.normal(0, 0.05, (len(self.stem_keys) + 1, DIM)).astype(np.float32)
        self.word[-1] = self.stem[-1] = 0
        self.kernels = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.kernel_bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out, self.bias = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.float32(0)

    @staticmethod
    def _rows(keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(buckets), np.int64)
        at = np.searchsorted(keys, buckets)
        return np.where(keys[np.minimum(at, len(keys) - 1)] == buckets, at, len(keys))

    def rows(self, words: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the embedding tables; the last one for buckets without one."""
        return self._rows(self.word_keys, words), self._rows(self.stem_keys, stems)

    def _maps(self, e: np.ndarray) -> list[np.ndarray]:
        """For each width the filters' values at every place but the padding at the end."""
        n = len(e) - max(WIDTHS) + 1
        return [sum(e[k : n + k] @ kernel[k] for k in range(len(kernel))) + self.kernel_bias[j] for j, kernel in enumerate(self.kernels)]

    def _padded(self, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
        e = np.zeros((max(len(words), 1) + max(WIDTHS) - 1, DIM), np.float32)
        e[: len(words)] = self.word[words] + self.stem[stems]
        return e

    def logits(self, words: np.ndarray, stems: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of a batch of texts; texts are laid out with padding between them."""
        counts, pad = np.diff(bounds), max(WIDTHS) - 1
        spans = np.maximum(counts, 1) + pad
        starts = np.cumsum(spans) - spans
        w, s = np.full(spans.sum(), len(self.word_keys)), np.full(spans.sum(), len(self.stem_keys))
        at = np.arange(len(words)) + np.repeat(starts - bounds[:-1], counts)
        w[at], s[at] = self.rows(words, stems)
        e = self.word[w] + self.stem[s]
        # a text's own places: the padding after it is left out of the maximum
        live = np.stack([starts, starts + spans - pad], axis=1).reshape(-1)
        found = []
        for z in self._maps(e):
            z = np.concatenate([z, np.full((pad, FILTERS), -np.inf, np.float32)])
            found.append(np.maximum.reduceat(z, np.minimum(live, len(z) - 1), axis=0)[::2])
        return np.maximum(np.concatenate(found, axis=1), 0) @ self.out + self.bias

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, rate: float, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        state: dict[str, np.ndarray] = {n: np.full(getattr(self, n).shape, 1e-3, np.float32) for n in ("word", "stem", "kernel_bias", "out")}
        kernel_state = [np.full(k.shape, 1e-3, np.float32) for k in self.kernels]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        order = np.arange(len(docs))
        docs = [self.rows(*d) for d in docs]
        for _ in range(epochs):
            rng.shuffle(order)
            for i in order:
                words, stems = docs[i]
                e = self._padded(words, stems)
                maps = self._maps(e)
                at = np.stack([z.argmax(axis=0) for z in maps])
                top = np.stack([z[a, np.arange(FILTERS)] for z, a in zip(maps, at, strict=True)])
                f = np.maximum(top, 0).reshape(-1)
                error = np.float32((1 / (1 + np.exp(-np.clip(f @ self.out + self.bias, -30, 30))) - y[i]) * weight[i])
                back = (error * self.out * (f > 0)).reshape(top.shape)
                self._step("out", state, slice(None), error * f, rate)
                self.bias -= np.float32(rate * 0.1) * error
                self._step("kernel_bias", state, slice(None), back, rate)
                for j, kernel in enumerate(self.kernels):
                    for k in range(len(kernel)):
                        place = at[j] + k
                        inside = place < len(words)
                        grad = back[j][:, None] * kernel[k].T  # (filters, DIM)
                        g = e[place].T * back[j]
                        kernel_state[j][k] += g * g
                        kernel[k] -= rate * g / np.sqrt(kernel_state[j][k])
                        for name, rows in (("word", words), ("stem", stems)):
                            r, back_of = np.unique(rows[place[inside]], return_inverse=True)
                            total = np.zeros((len(r), DIM), np.float32)
                            np.add.at(total, back_of, grad[inside])
                            total[r == len(getattr(self, name)) - 1] = 0  # the zero row stays
                            self._step(name, state, r, total, rate)

    def _step(self, name: str, state: dict[str, np.ndarray], at, grad: np.ndarray, rate: float) -> None:
        state[name][at] += grad * grad
        getattr(self, name)[at] -= rate * grad / np.sqrt(state[name][at])


@dataclass
class ToxicModel:
    net: Net
    slope: float
    intercept: float
    languages: lang_id.LangModel
    thresholds: dict[str, float]  # by predicted language; '' for all others

    def scores(self, column: pa.Array) -> tuple[np.ndarray, list[str]]:
        p = sigmoid(self.slope * self.net.logits(*word_rows(column)) + self.intercept)
        langs = [self.languages.langs[k] for k in self.languages.probabilities(column).argmax(axis=1)]
        t = np.array([self.thresholds.get(x, self.thresholds[""]) for x in langs])
        low, high = THRESHOLD * p / t, 1 - (1 - THRESHOLD) * (1 - p) / (1 - t)
        return np.clip(np.where(p >= t, np.maximum(high, THRESHOLD), np.minimum(low, np.nextafter(THRESHOLD, 0))), 0, 1), langs


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of ``y`` on ``z`` with Platt's smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(z)), 1e-6)
    x, a, b = z / scale, 1.0, 0.0
    for _ in range(steps):  # Newton's method with a small ridge
        p = sigmoid(a * x + b)
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * x * x).sum(), (q * x).sum()], [(q * x).sum(), q.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return a / scale, b


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the cut between two scores that misjudges the fewest rows, each label weighing the same."""
    order = np.argsort(p)
    p, y = p[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(y.sum(), 1)
    alarmed = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / max((1 - y).sum(), 1)
    k = int(np.argmin(missed + alarmed))
    low, high = (p[k - 1] if k else 0.0), (p[k] if k < len(p) else 1.0)
    return float(np.clip((low + high) / 2, 0.02, 0.98))


def train(table: pa.Table, languages: lang_id.LangModel, updates: int, rate: float) -> ToxicModel:
    """table: (doc_id, label, lang, words, stems) with the buckets of words and stems as bytes."""
    rows = table.sort_by([("doc_id", "ascending"), ("words", "ascending")]).to_pylist()
    docs = [(np.frombuffer(r["words"], np.int32), np.frombuffer(r["stems"], np.int32)) for r in rows]
    y = np.array([r["label"] for r in rows], np.float64)
    if len(set(y)) < 2:
        net = Net([])
        net.out[:] = 0
        return ToxicModel(net, 1.0, 5.0 if len(y) and y[0] else -5.0, languages, {"": 0.5})
    apart = np.arange(len(rows)) % 5 == 0
    if min((y[apart] == 1).sum(), (y[apart] == 0).sum()) < 20:
        apart[:] = False
    fit_at = np.flatnonzero(~apart)
    net = Net([docs[i] for i in fit_at], min(SHARED_BY, 1 + len(fit_at) // 50))
    net.fit([docs[i] for i in fit_at], y[fit_at], int(np.clip(updates // len(fit_at), 2, 12)), rate)
    hold = np.flatnonzero(apart) if apart.any() else np.arange(len(rows))
    bounds = np.concatenate([[0], np.cumsum([len(docs[i][0]) for i in hold])])
    z = net.logits(np.concatenate([docs[i][0] for i in hold]), np.concatenate([docs[i][1] for i in hold]), bounds)
    slope, intercept = platt(z, y[hold])
    p, langs = sigmoid(slope * z + intercept), np.array([rows[i]["lang"] for i in hold])
    thresholds = {"": best_threshold(p, y[hold])}
    for lang in sorted(set(langs)):
        own = langs == lang
        if min((y[hold][own] == 1).sum(), (y[hold][own] == 0).sum()) >= 20:
            thresholds[lang] = best_threshold(p[own], y[hold][own])
    return ToxicModel(net, slope, intercept, languages, thresholds)


def fit(sample: DataFrame, languages: lang_id.LangModel, updates: int = 8000, rate: float = 0.05) -> ToxicModel:
    """sample: a bounded set of (doc_id, text, label); a fifth of it calibrates what the rest has trained (all of
    it, if that fifth has fewer than 20 rows of a label). Trains in one task for about ``updates`` steps, 2 to 12
    epochs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", lang_id.BLOCK, counted_rows(lang_id.BITS)):
            words, stems, bounds = word_rows(b.column("text"))
            langs = [languages.langs[k] for k in languages.probabilities(b.column("text")).argmax(axis=1)]
            cut = [slice(bounds[i], bounds[i + 1]) for i in range(b.num_rows)]
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "label": b.column("label"), "lang": pa.array(langs),
                "words": pa.array([words[c].tobytes() for c in cut], pa.binary()), "stems": pa.array([stems[c].tobytes() for c in cut], pa.binary()),
            })

    schema = "doc_id bigint, label int, lang string, words binary, stems binary"
    found = sample.select("doc_id", "text", "label").mapInArrow(run, schema)
    return fitted(found, lambda rows: train(rows, languages, updates, rate))


def score(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """Adds score (0 to 1; the language's threshold is at 0.7) and lang_pred to ``docs``; all columns stay.

    Null and empty texts are scored as no words. A score at the threshold counts as toxic. Columns named score and lang_pred,
    in any case, are replaced.
    """
    held = shared(docs.sparkSession, model)
    names = others(docs.columns, "score", "lang_pred")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, text, lang_id.BLOCK, counted_rows(lang_id.BITS)):
            p, langs = m.scores(b.column(text))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(p.astype(np.float64)), pa.array(langs, pa.string())], [*names, "score", "lang_pred"])

    return docs.select(*names).mapInArrow(run, docs.select(*names).schema.add("score", "double").add("lang_pred", "string"))
