import re

import numpy as np
import pyarrow as pa
import pytest

from strokeframe.llm import flat
from strokeframe.llm.flat import Words, gram_counts, range_hash, slices, text_bytes

TEXTS = ["", None, "Ab c", "  x\ty\nz ", "one", "a" * 5000, "é È b", "ab c", "x" * 3 + " " + "y" * 700_000 + " ab"]


def split(t, pattern="[\x20\x09-\x0d]+"):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split(pattern, lower) if w]


def test_words_match_a_plain_split():
    w = Words(pa.array(TEXTS))
    raw, _ = text_bytes(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        got = [bytes(w.raw[s:e]).decode() for s, e in zip(w.starts, w.ends, strict=True)][w.bounds[i] : w.bounds[i + 1]]
        assert got == split(t)


def test_hash_depends_on_the_bytes_alone():
    """The same word has the same hash in any batch, block and place, and other words have others."""
    alone = Words(pa.array(["ab"])).hashes[0]
    w = Words(pa.array(TEXTS + ["q " * 400_000 + "ab"]))
    words = [bytes(w.raw[s:e]) for s, e in zip(w.starts, w.ends, strict=True)]
    by_word = {}
    for x, h in zip(words, w.hashes.tolist(), strict=True):
        assert by_word.setdefault(x, h) == h
    assert by_word[b"ab"] == alone
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("n", [1, 3, 4])
def test_shingles(n):
    w = Words(pa.array(TEXTS[:8]))
    h, bounds = w.shingles(n)
    seen = {}
    for i, t in enumerate(TEXTS[:8]):
        words = split(t)
        runs = [tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
        assert bounds[i + 1] - bounds[i] == len(runs)
        for r, x in zip(runs, h[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert seen.setdefault(r, x) == x
    assert len(set(seen.values())) == len(seen)


def test_gram_counts_stay_inside_texts():
    raw, off = text_bytes(pa.array(["abab", "", "b", "ab"]))
    c = gram_counts(raw, off, (2,), 10)
    assert c.sum(axis=1).tolist() == [3, 0, 0, 1]
    assert np.count_nonzero(c[0]) == 2 and c[0][c[3] > 0] == 2


def test_slices_keep_all_rows():
    b = pa.record_batch({"t": pa.array(["a" * 10, None, "b" * 50, "", "c"]), "i": pa.array(range(5))})
    got = list(slices(iter([b]), "t", 12))
    assert [r for x in got for r in x.column("i").to_pylist()] == list(range(5)) and len(got) > 1


def test_punctuation_words():
    w = Words(pa.array(["Don't, stop!été"]), punctuation=True)
    assert [bytes(w.raw[s:e]).decode() for s, e in zip(w.starts, w.ends, strict=True)] == ["don", "t", "stop", "été"]
    assert len(range_hash(w.raw, w.starts, w.ends)) == 4 and flat.BLOCK > flat.HASHED
