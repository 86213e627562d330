"""Arrow string columns as flat byte arrays: words, hashes and grams of a batch without a loop over texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK = 4 << 20
#: Texts that are worked on at once.
ROWS = 1 << 14
#: Bytes that are hashed at once.
HASHED = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but digits and letters.
_PUNCTUATION = np.ones(256, bool)
_PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = column.type in (pa.large_string(), pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if column.type in (pa.string(), pa.large_string()) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray, most: int = BLOCK, rows: int = ROWS) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of at most ``rows`` rows of at most ``most`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, min(i + rows, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j
        i = j


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that they have at most ``rows`` rows, and ``column`` at most ``most`` bytes or one row."""
    for batch in batches:
        if batch.num_rows:
            _, off = text_bytes(batch.column(column))
            for i, j in blocks(off, most, rows):
                yield batch.slice(i, j - i)


def counted_rows(bits: int) -> int:
    """The rows whose gram_counts() are worked on at once: 2^22 cells."""
    return max(1, (1 << 22) >> bits)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash's base and of its inverse modulo 2^64."""
    base, inverse = np.full(n + 1, _ODD), np.full(n + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    base[0] = inverse[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


_BASE, _INVERSE = _powers(HASHED)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def range_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range (uint64), that depends on its bytes alone; ranges are in order and do not overlap.

    A polynomial modulo 2^64 by prefix sums, worked out in blocks of about HASHED bytes.
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + HASHED, "right")))
        n = int(ends[j - 1] - first)
        base, inverse = (_BASE, _INVERSE) if n <= HASHED else _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw[first : first + n]] * base[:n], out=sums[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Words:
    """The words of a batch of texts: hash, byte range, and for each text the range of its words."""

    def __init__(self, column: pa.Array, lower: bool = True, punctuation: bool = False):
        """Words are runs of bytes other than 0x20 and 0x09-0x0D, with ``punctuation`` of digits, letters and bytes
        beyond ASCII only; with ``lower`` A-Z count as a-z."""
        raw, off = text_bytes(column)
        inside = ~(_PUNCTUATION if punctuation else _SPACE)[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        filled = off[:-1][off[1:] > off[:-1]]  # texts follow one another without a gap
        first[filled] = inside[filled]
        last[filled[1:] - 1] = inside[filled[1:] - 1]
        self.raw = _LOWER[raw] if lower else raw
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, off)
        self.offsets = off
        self.hashes = range_hash(self.raw, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds) of runs of ``n`` words; a text of fewer words, but not none, has its whole sequence as one."""
        h, counts = self.hashes, self.counts()
        per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        bounds = np.concatenate([[0], np.cumsum(per)])
        out = np.zeros(bounds[-1], np.uint64)
        if len(h) >= n:
            runs = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                runs = runs * _ODD + h[k : len(h) - n + 1 + k]
            runs = mix(runs + np.uint64(n))
            long = np.flatnonzero(counts >= n)
            at = np.repeat(self.bounds[:-1][long] - bounds[:-1][long], per[long])
            place = np.repeat(bounds[:-1][long], per[long]) + _ranks(per[long])
            out[place] = runs[at + place]
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            x = np.zeros(1, np.uint64)
            for w in h[self.bounds[i] : self.bounds[i + 1]]:
                x = x * _ODD + w
            out[bounds[i]] = mix(x + np.uint64(counts[i]))[0]
        return out, bounds


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of ``counts``, in a row."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def gram_counts(raw: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """float32 array (texts, 2^bits): counts of the hashed byte n-grams (n up to 4) inside each text."""
    n, width = len(offsets) - 1, (1 << bits) + 1
    out = np.zeros(n * width, np.float32)
    x = raw.astype(np.uint32)
    base = np.repeat(np.arange(n, dtype=np.int64) * width, np.diff(offsets))
    for size in sizes:
        if len(raw) < size:
            continue
        h = np.full(len(raw) - size + 1, size, np.uint32)
        for k in range(size):
            h = h * np.uint32(0x01000193) ^ x[k : len(raw) - size + 1 + k]
        bucket = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)
        for k in range(1, size):  # grams across the end of a text go into the last column
            cut = offsets[1:-1] - k
            bucket[cut[(cut >= 0) & (cut < len(h))]] = width - 1
        out += np.bincount(base[: len(h)] + bucket, minlength=n * width).astype(np.float32)
    return out.reshape(n, width)[:, :-1]
