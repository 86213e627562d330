"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne 2007).

Words and word pairs are counted over all training texts. Counts are quantised in steps of half an octave, and an
n-gram of level q is put into the filter once for each level from 1 to q; a reader probes level after level
until one is absent. The filter is made segment by segment - an n-gram's probes stay within the segment that its
hash names - and broadcast in pieces, or beyond FILTER_BYTES left as a written table that is asked segment by
segment. All words and pairs are in it at every size.

A pair's share of its history is the least count of its level over the greatest of the history's, so that the
shares of a history add up to no more than 1; words' quantised counts are divided by their sum. The probability
interpolates the two, with the Good-Turing estimate of the mass of seen pairs as the pairs' weight, and adds up to
no more than 1 over all words but for what false answers of the filter add (about 1 in 100 absent n-grams of its
segment is taken for one that was seen once).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import Words, mix, slices
from .store import shared, written

PROBES, BITS_PER_ENTRY = 4, 10
#: Bytes of the filter and of the exact word counts up to which they are broadcast, and of one piece of them.
FILTER_BYTES, COUNTS_BYTES, PIECE_BYTES = 128 << 20, 64 << 20, 16 << 20
#: Tokens that a task counts before it hands counts on.
FLUSH = 2 << 20
BLOCK = 2 << 20
START, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
_PAIR, _LEVEL = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

Lookup = Callable[[np.ndarray], np.ndarray]


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, the words before them, bounds): hashes of each text's words and its end; START comes before the first."""
    w = Words(column)
    n = len(w.bounds) - 1
    bounds = w.bounds + np.arange(n + 1)
    words = np.full(bounds[-1], END, np.uint64)
    ends = bounds[1:] - 1
    inner = np.ones(len(words), bool)
    inner[ends] = False
    words[inner] = w.hashes
    before = np.empty(len(words), np.uint64)
    before[1:] = words[:-1]
    before[bounds[:-1]] = START
    return words, before, bounds


def pair_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + words)


#: The least count of each level: 1, 2, 3, 4, 6, 8, 12, 16, ...; level 0 is absent. And the greatest, and the mean.
FLOOR = np.array([0, 1, *sorted([2.0**k for k in range(1, 62)] + [1.5 * 2.0**k for k in range(1, 62)])])
UPPER = np.concatenate([FLOOR[1:] - 1, [2.0**63]])
MEAN = (FLOOR + UPPER) / 2


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(FLOOR, counts, "right") - 1


def _place(keys: np.ndarray, level: int, k: int, bits: np.ndarray) -> np.ndarray:
    """The k-th of the PROBES bit numbers of each key at a level, below ``bits``."""
    h = mix(keys + np.uint64(level * int(_LEVEL) & (1 << 64) - 1))
    h = h + np.uint64(k) * (mix(h) | np.uint64(1)) if k else h
    return (h >> np.uint64(11)) % bits


def filter_bits(keys: np.ndarray, q: np.ndarray, bits: int) -> np.ndarray:
    """A segment's filter (packed) with the keys at all their levels."""
    flags = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for k in range(PROBES):
            flags[_place(keys[q >= level], level, k, np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def _probe(table: np.ndarray, keys: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The level of each key by repeated membership probes from bit ``start`` on; 0 is absent."""
    found = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    for level in range(1, len(FLOOR)):
        for k in range(PROBES):  # most absent keys go at the first probe
            at = start[live] + _place(keys[live], level, k, size[live]).astype(np.int64)
            live = live[(table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
            if not len(live):
                return found
        found[live] = level
    return found


@dataclass
class Piece:
    """Some segments of the filter and of the exact word counts."""

    segments: np.ndarray
    table: np.ndarray  # the packed filters, segment after segment
    starts: np.ndarray  # of each segment, in bits
    sizes: np.ndarray  # of each segment, in bits
    keys: np.ndarray  # hashes of words, in order
    counts: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, bytes, bytes, bytes]]) -> Piece:
        """rows: (segment, bits, keys, counts)."""
        rows = sorted(rows)
        sizes = np.array([8 * len(r[1]) for r in rows], np.int64)
        packed = [b"".join(r[k] for r in rows) for k in (1, 2, 3)]
        counts = np.frombuffer(packed[2], np.int64)
        return cls(np.array([r[0] for r in rows], np.int64), np.frombuffer(packed[0], np.uint8), np.cumsum(sizes) - sizes, sizes, np.frombuffer(packed[1], np.uint64), counts)

    def level(self, keys: np.ndarray, segment_bits: int) -> np.ndarray:
        """The level of each key, all of which are of these segments."""
        at = np.searchsorted(self.segments, (keys >> np.uint64(64 - segment_bits)).astype(np.int64))
        return _probe(self.table, keys, self.starts[at], self.sizes[at].astype(np.uint64))


def lookups(pieces: list[Piece], segment_bits: int) -> tuple[Lookup, Lookup]:
    """Functions that give the exact count, and the level, of each of some hashes in order."""
    route = np.full(1 << segment_bits, len(pieces), np.uint16)
    for i, p in enumerate(pieces):
        route[p.segments] = i

    def asked(keys: np.ndarray, answer: Callable[[Piece, np.ndarray], np.ndarray]) -> np.ndarray:
        of, found = route[(keys >> np.uint64(64 - segment_bits)).astype(np.int64)], np.zeros(len(keys), np.int64)
        for i, p in enumerate(pieces):
            own = np.flatnonzero(of == i)
            if len(own):
                found[own] = answer(p, keys[own])
        return found

    return (lambda keys: asked(keys, lambda p, own: _found(p.keys, p.counts, own))), (lambda keys: asked(keys, lambda p, own: p.level(own, segment_bits)))


@dataclass
class Model:
    segment_bits: int
    texts: int
    tokens: int
    distinct: int
    mass: float  # the sum of all words' quantised counts
    pair_weight: float
    filter_bytes: int
    most_bytes: int  # of a filter that is broadcast

    def log10(self, words: np.ndarray, before: np.ndarray, level: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """log10 of each token's probability after the token before it; ``level`` tells the level of each of some hashes."""
        distinct, at = np.unique(np.concatenate([words, before]), return_inverse=True)
        q = level(distinct)
        known = UPPER[q]
        known[distinct == START] = self.texts
        c_word, c_before = MEAN[q][at[: len(words)]], known[at[len(words) :]]
        pairs, at = np.unique(pair_hash(before, words), return_inverse=True)
        c_pair = FLOOR[level(pairs)][at]
        alone = (c_word + 0.5) / (self.mass + 0.5 * (self.distinct + 1))
        together = np.minimum(c_pair / np.maximum(c_before, 1), 1)
        # an unknown word before it tells nothing
        weight = np.where(c_before > 0, self.pair_weight, 0)
        return np.log10(weight * together + (1 - weight) * alone)


def _count(docs: DataFrame, segment_bits: int) -> DataFrame:
    """(segment, pair, keys, counts): packed arrays of n-gram hashes and counts, added up within each task."""

    def flush(parts: list[np.ndarray], pair: int) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        segment = (keys >> np.uint64(64 - segment_bits)).astype(np.int32)
        edges = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(keys)]
        counts = counts.astype(np.int64)
        yield pa.record_batch({
            "segment": pa.array(segment[edges[:-1]]), "pair": pa.array(np.full(len(edges) - 1, pair, np.int32)),
            "keys": pa.array([keys[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)], pa.binary()),
            "counts": pa.array([counts[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        n = 0
        for b in slices(batches, "text", BLOCK):
            words, before, _ = tokens_of(b.column("text"))
            held[0].append(words)
            held[1].append(pair_hash(before, words))
            n += len(words)
            if n >= FLUSH:
                for pair in (0, 1):
                    yield from flush(held[pair], pair)
                    held[pair].clear()
                n = 0
        if n:
            for pair in (0, 1):
                yield from flush(held[pair], pair)

    return docs.mapInArrow(run, "segment int, pair int, keys binary, counts binary")


def _merged(table: pa.Table, pair: int) -> tuple[np.ndarray, np.ndarray]:
    rows = table.filter(pc.equal(table["pair"], pair))
    keys, counts = _joined(rows["keys"], np.uint64), _joined(rows["counts"], np.int64)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


def segments_for(texts: int, segment_rows: int) -> int:
    """Bits of a segment's number: a segment for every ``segment_rows`` texts, beyond 4096 for every sixteen times as many."""
    return max(4, min(12, int(np.ceil(np.log2(max(texts / segment_rows, 1))))), min(30, int(np.ceil(np.log2(max(texts / segment_rows / 16, 1))))))


def fit(docs: DataFrame, filter_bytes: int = FILTER_BYTES, segment_rows: int = 1000) -> tuple[Model, DataFrame]:
    """(model, grams) of all rows of ``docs`` (text); null counts as the empty text, which is one end.

    grams (segment, bits, keys, counts, ...) has each segment's filter of words and pairs, and the exact counts of
    its words; it stays a table in the shared folder. A filter of more than ``filter_bytes`` is not broadcast.
    """
    texts = docs.count()
    segment_bits = segments_for(texts, segment_rows)

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table, 0)
        pairs, pair_counts = _merged(table, 1)
        q = np.concatenate([levels(counts), levels(pair_counts)])
        bits = -(-max(64, int(q.sum()) * BITS_PER_ENTRY) // 8) * 8
        return pa.table({
            "segment": pa.array([table.column("segment")[0].as_py()], pa.int32()),
            "bits": pa.array([filter_bits(np.concatenate([keys, pairs]), q, bits).tobytes()], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()), "size": pa.array([bits // 8]), "n": pa.array([len(keys)]), "tokens": pa.array([int(counts.sum())]),
            "single": pa.array([int((pair_counts == 1).sum())]), "mass": pa.array([float(MEAN[levels(counts)].sum())]),
        })

    schema = "segment int, bits binary, keys binary, counts binary, size bigint, n bigint, tokens bigint, single bigint, mass double"
    grams = written(_count(docs, segment_bits).groupBy("segment").applyInArrow(merge, schema), "grams")
    size, distinct, tokens, single, mass = grams.agg(*[F.sum(c) for c in ("size", "n", "tokens", "single", "mass")]).first()
    weight = float(np.clip(1 - single / tokens if tokens else 0.0, 0.0, 0.95))
    return Model(segment_bits, texts, tokens or 0, distinct or 0, mass or 0.0, weight, size or 0, filter_bytes), grams


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key among sorted keys; 0 where it is absent."""
    at = np.searchsorted(keys, asked)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == asked[hit]
    out = np.zeros(len(asked), values.dtype)
    out[hit] = values[at[hit]]
    return out


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(b: pa.RecordBatch, m: Model, exact: Lookup, level: Lookup) -> pa.RecordBatch:
    """The scores of a batch (doc_id, text), with the exact count and the level of each of some hashes."""
    tokens, before, bounds = tokens_of(b.column("text"))
    seen, at = np.unique(tokens, return_inverse=True)
    c = exact(seen).astype(np.float64)
    # with no training token at all, every token has the probability 1
    base = (np.log10(c + 0.5) - np.log10(m.tokens + 0.5 * (m.distinct + 1)) if m.distinct else np.zeros(len(seen)))[at]
    own = m.log10(tokens, before, level) if m.distinct else np.zeros(len(tokens))
    first = bounds[:-1]
    return pa.record_batch({
        "doc_id": b.column("doc_id"), "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(np.add.reduceat((c > 0)[at].astype(np.int64), first)),
        "train_tokens": pa.array(np.full(len(first), m.tokens)), "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(own, first)),
    })


def broadcast_pieces(grams: DataFrame, piece_bytes: int = PIECE_BYTES) -> list[Broadcast]:
    """``grams`` broadcast in pieces of about ``piece_bytes``; the driver holds one partition and one piece at a time."""
    made, rows, size = [], [], 0
    for r in grams.select("segment", "bits", "keys", "counts").toLocalIterator():
        rows.append(tuple(r))
        size += len(r["bits"]) + len(r["keys"]) + len(r["counts"])
        if size >= piece_bytes:
            made.append(shared(grams.sparkSession, Piece.of(rows)))
            rows, size = [], 0
    return [*made, shared(grams.sparkSession, Piece.of(rows))] if rows else made


def score(docs: DataFrame, model: Model, grams: DataFrame, most_bytes: int = COUNTS_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    Words are split at white space with A-Z lower-cased, and one end follows; null counts as the empty text.
    n_known and base_score use exact counts: base_score is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))).
    Every row gives one row, also where doc_id is null or repeated. A filter beyond the model's bound, or word
    counts of more than ``most_bytes``, are asked segment by segment; the rows are the same.
    """
    if model.filter_bytes > model.most_bytes or model.distinct * 16 > most_bytes:
        return _score_by_segment(docs, model, grams)
    pieces = broadcast_pieces(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, level = lookups([p.value for p in pieces], model.segment_bits)
        for b in slices(batches, "text", BLOCK):
            yield _scored(b, model, exact, level)

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def _score_by_segment(docs: DataFrame, model: Model, grams: DataFrame) -> DataFrame:
    """score() for tables that no process holds: the rows are written in blocks, each block's distinct n-grams go
    once to their segments, and what is known of them comes back to the block."""
    segment_bits = model.segment_bits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, b in enumerate(slices(batches, "text", BLOCK)):
            yield pa.record_batch({"block": pa.array(np.full(b.num_rows, first + k)), "doc_id": b.column("doc_id"), "text": b.column("text")})

    dealt = written(docs.select("doc_id", "text").mapInArrow(deal, "block bigint, doc_id bigint, text string"), "blocks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                tokens, before, _ = tokens_of(b.column("text").slice(i, j - i))
                keys = np.unique(np.concatenate([tokens, pair_hash(before, tokens)]))
                segment = (keys >> np.uint64(64 - segment_bits)).astype(np.int32)
                cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(keys)]
                yield pa.record_batch({
                    "segment": pa.array(segment[cuts[:-1]]), "block": pa.array(np.full(len(cuts) - 1, block[i])),
                    "keys": pa.array([keys[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                })

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        parts = asked["keys"].to_pylist()
        keys, at = np.unique(np.frombuffer(b"".join(parts), np.uint64), return_inverse=True)
        ends = np.cumsum([len(p) // 8 for p in parts], dtype=np.int64)
        split = lambda values: pa.array([values[at[e - len(p) // 8 : e]].tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary())
        counts, level = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for row in held.to_pylist():  # one or none
            exact, levelled = lookups([Piece.of([(row["segment"], row["bits"], row["keys"], row["counts"])])], segment_bits)
            counts, level = exact(keys), levelled(keys)
        return pa.table({"block": asked["block"], "keys": asked["keys"], "counts": split(counts), "levels": split(level.astype(np.uint8))})

    def finish(rows: pa.Table, known: pa.Table) -> pa.Table:
        keys, first = np.unique(_joined(known["keys"], np.uint64), return_index=True)
        counts, levels_ = _joined(known["counts"], np.int64)[first], _joined(known["levels"], np.uint8)[first]
        exact, level = (lambda asked: _found(keys, counts, asked)), (lambda asked: _found(keys, levels_, asked))
        return pa.Table.from_batches([_scored(b, model, exact, level) for b in slices(rows.to_batches(), "text", BLOCK)])

    asked = dealt.select("block", "text").mapInArrow(ask, "segment int, block bigint, keys binary")
    held = grams.select("segment", "bits", "keys", "counts")
    known = asked.groupBy("segment").cogroup(held.groupBy("segment")).applyInArrow(answer, "block bigint, keys binary, counts binary, levels binary")
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(finish, SCORED)
