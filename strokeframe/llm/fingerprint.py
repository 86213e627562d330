"""Document fingerprints: digests of statistically improbable features (after Roussev 2010).

Every window of 32 bytes has an entropy; how rare its entropy is in the corpus ranks it. A window that is
the rarest within many overlapping neighbourhoods is a feature. Features go, in order, into a chain of
Bloom filters of 2048 bits with at most 160 features each, and two chains are compared by the overlap of
their bits beyond what chance gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import BLOCK, range_hash, slices, text_bytes
from .names import others
from .store import shared

WINDOW, NEIGHBOURHOOD, POPULAR = 32, 32, 16
FILTER_BYTES, PROBES, FULL, LEAST = 256, 5, 160, 6
#: Entropies are told apart in so many steps.
STEPS = 1000
#: A piece of text that is worked on at once, to stay in the processor's cache.
PIECE = 1 << 16

RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])

#: n log2 n in 2^-16ths: whole numbers, so that a window's sum does not depend on where the sliding began.
_NLOGN = np.concatenate([[0], np.rint(np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1)) * 65536)]).astype(np.int32)
_GAIN = np.diff(_NLOGN)  # of n log n when a count n goes to n + 1
_FULL = int(_NLOGN[WINDOW])


def _entropies(raw: np.ndarray) -> np.ndarray:
    """Entropy step (0 to STEPS) of each window of WINDOW bytes of one piece."""
    n = len(raw) - WINDOW + 1
    after, before = np.zeros(len(raw), np.uint8), np.zeros(len(raw), np.uint8)  # equal bytes among the next and last WINDOW - 1
    for k in range(1, WINDOW):
        same = (raw[k:] == raw[:-k]).view(np.uint8)
        after[: len(same)] += same
        before[k:] += same
    first = np.bincount(raw[:WINDOW], minlength=256)
    # sliding by one byte takes one away and adds one: n log n changes by the gains at their counts
    change = _GAIN[before[WINDOW:]] - _GAIN[after[: n - 1]]
    # the byte that leaves and the one that comes do not see each other unless they are equal, and then nothing changes
    equal = raw[WINDOW:] == raw[: n - 1]
    change[equal] = 0
    sums = np.empty(n, np.int32)
    sums[0] = _NLOGN[first].sum()
    np.cumsum(change, out=sums[1:])
    sums[1:] += sums[0]
    return ((_FULL - sums).astype(np.float64) * (STEPS / _FULL)).astype(np.int16)


def entropy_steps(raw: np.ndarray) -> np.ndarray:
    """Of each window of a text; empty if the text is shorter than a window."""
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    return np.concatenate([_entropies(raw[i : min(i + PIECE, n) + WINDOW - 1]) for i in range(0, n, PIECE)])


def features(keys: np.ndarray, shift: int) -> np.ndarray:
    """The places of a text's features, in order; keys: rank << shift | place, of each of its windows."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    least, reach, span = keys, min(NEIGHBOURHOOD, n), 1
    while span < reach:  # minimum over ever longer runs: the leftmost of equal ranks
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    mask = keys.dtype.type((1 << shift) - 1)
    first = int(keys[0] & mask)
    votes = np.bincount((least & mask).astype(np.int64) - first, minlength=n)
    return np.flatnonzero(votes >= min(POPULAR, len(least)))


def _chain(hashes: np.ndarray) -> bytes:
    """The filters of these features, each after a byte with their number."""
    chain = []
    for i in range(0, len(hashes), FULL):
        part = hashes[i : i + FULL]
        bits = np.zeros(FILTER_BYTES * 8, bool)
        for k in range(PROBES):
            bits[((part >> np.uint64(11 * k)) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.int64)] = True
        chain.append(bytes([len(part)]) + np.packbits(bits).tobytes())
    return b"".join(chain)


def digests(raw: np.ndarray, off: np.ndarray, ranks: np.ndarray) -> list[bytes]:
    """The chain of filters of each text raw[off[i]:off[i+1]].

    A text without features, as one shorter than a window, has a single one: a hash of the whole text.
    """
    steps, out = entropy_steps(raw), []
    kind, shift = (np.uint32, 22) if len(steps) < 1 << 22 else (np.int64, 40)  # STEPS takes 10 bits
    keys = ranks.astype(kind)[steps] << kind(shift) | np.arange(len(steps), dtype=kind)
    for i, j in zip(off[:-1], off[1:], strict=True):
        starts = features(keys[i : max(i, j - WINDOW + 1)], shift)
        if len(starts):
            # windows overlap, so they are gathered first
            flat = raw[i : j][(starts[:, None] + np.arange(WINDOW)).reshape(-1)]
            at = np.arange(len(starts)) * WINDOW
            hashes, first = np.unique(range_hash(flat, at, at + WINDOW), return_index=True)
            hashes = hashes[np.argsort(first)]  # a repeated feature counts once, where it first stands
        else:
            hashes = range_hash(raw[i:j], np.zeros(1, np.int64), np.full(1, j - i))
        out.append(_chain(hashes))
    return out


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: the mean, over the shorter chain's filters, of the best overlap beyond chance with one of the other's."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(d, np.uint8).reshape(-1, FILTER_BYTES + 1) for d in (a, b))
    if len(x) > len(y):
        x, y = y, x
    # a last filter with very few features says little, unless it is all there is
    x = x[x[:, 0] >= LEAST] if (x[:, 0] >= LEAST).any() else x
    y = y[y[:, 0] >= LEAST] if (y[:, 0] >= LEAST).any() else y
    bits_x, bits_y = (np.unpackbits(z[:, 1:], axis=1).astype(np.float32) for z in (x, y))
    both = bits_x @ bits_y.T
    set_x, set_y = bits_x.sum(axis=1)[:, None], bits_y.sum(axis=1)[None, :]
    chance, most = set_x * set_y / (FILTER_BYTES * 8), np.minimum(set_x, set_y)
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float(score.max(axis=1).mean())


def rarity_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy step, from the rarest up, by its count over all windows of all texts.

    Steps that do not occur, and windows of hardly any distinct bytes, come last. The counts are STEPS + 1
    numbers, whatever the corpus. Ranks may be kept, so that fingerprints of several corpora compare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)
        for b in slices(batches, text):
            raw, off = text_bytes(b.column(text))
            steps = entropy_steps(raw)
            across = np.zeros(len(steps) + 1, np.int64)  # windows that reach over the end of a text do not count
            np.add.at(across, np.clip(off[1:-1] - WINDOW + 1, 0, len(steps)), 1)
            np.add.at(across, np.clip(off[1:-1], 0, len(steps)), -1)
            total += np.bincount(steps[np.cumsum(across[:-1]) == 0], minlength=STEPS + 1)
        yield pa.record_batch({"step": pa.array(np.arange(STEPS + 1)), "n": pa.array(total)})

    counts = docs.select(text).mapInArrow(run, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(STEPS + 1, np.int64)
    for r in counts:
        n[r["step"]] = r["n"]
    n[: STEPS // 10] = np.iinfo(np.int64).max
    n[n == 0] = np.iinfo(np.int64).max
    ranks = np.empty(STEPS + 1, np.int64)
    ranks[np.argsort(n, kind="stable")] = np.arange(STEPS + 1)
    return ranks


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, doc_id, text, halo): the rows of each range of doc_id, and once more, as ``halo``, the row that
    follows the range's last in descending order (after the very last: the first). One shuffle of the texts."""
    order_key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = docs.select("doc_id", order_key.alias("key"), F.coalesce("text", F.lit("")).alias("text"), bucket.cast("int").alias("bucket"))
    # the highest id of each range: as many rows as ranges
    tops = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("key").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    # a range's top follows the last of the range above it; the highest of all closes the circle
    pairs = [x for i, b in enumerate(order) for x in (F.lit(tops[b]), F.lit(order[i - 1]))]
    also = F.try_element_at(F.create_map(*pairs), F.col("key")) if pairs else F.lit(None).cast("int")
    here = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo")))
    there = F.when(also.isNotNull(), F.array(F.struct(also.alias("bucket"), F.lit(True).alias("halo")))).otherwise(F.array().cast("array<struct<bucket:int,halo:boolean>>"))
    placed = rows.select("doc_id", "key", "text", F.explode(F.concat(here, there)).alias("p")).select("p.bucket", "p.halo", "doc_id", "key", "text")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "halo", F.col("key").desc(), "text")


def compare_with_edits(docs: DataFrame, ranks: np.ndarray, bucket: Column) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the one with the next lower doc_id; rows that share a doc_id follow one another in
    the order of their texts, rows without one come last. ``bucket`` numbers ranges of doc_id. Null counts
    as the empty text.
    """
    given = shared(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = given.value
        held: tuple | None = None  # bucket, doc_id, text, digest: the row before, until the next is seen
        for b in slices(batches, "text", BLOCK):
            own = digests(*text_bytes(b.column("text")), r)
            pairs = []
            for *row, now, halo in zip(b.column("bucket").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), own, b.column("halo").to_pylist(), strict=True):
                if held is not None and held[0] == row[0]:
                    pairs.append((held, (row[2], now)))
                held = None if halo else (*row, now)
            changed = pa.array([edited(x[2], y[0]) for x, y in pairs], pa.string())
            after = digests(*text_bytes(changed), r)
            rows = [
                (
                    x[1], len(x[2]), hashlib.sha256(t.encode()).hexdigest(), base64.b64encode(x[3]).decode(),
                    base64.b64encode(a).decode(), likeness(x[3], a), likeness(x[3], y[1]),
                )
                for (x, y), t, a in zip(pairs, changed.to_pylist(), after, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(RESULT)], schema=RESULT)

    placed = with_following(docs, bucket).select("bucket", "doc_id", "text", "halo")
    return placed.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, ranks: np.ndarray, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` to ``docs``: equal texts have equal ones; null counts as the empty text. All columns stay (one of
    that name, in any case, is replaced)."""
    given = shared(docs.sparkSession, ranks)
    names = others(docs.columns, "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            found = [base64.b64encode(x).decode() for x in digests(*text_bytes(b.column(text)), given.value)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(found, pa.string())], [*names, "fingerprint"])

    return docs.select(*names).mapInArrow(run, docs.select(*names).schema.add("fingerprint", "string"))
