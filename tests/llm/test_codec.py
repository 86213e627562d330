"""The SentencePiece codec against the sentencepiece library."""

import random

import numpy as np
import pytest
import sentencepiece

from strokeframe.llm import sentencepiece_codec as sp

MODEL = open(sp.MODEL, "rb").read()
PIECES = ["a", "b", "e", "t", "h", "n", " ", " ", "▁", "\n", "\t", "é", "ß", "中", "文", "🙂", "0", "1", ".", "  ", "   ", "the", "ing", "\x00", "aaaa", "http", "://", "한", "국"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 60))) for _ in range(n)]


def chunked(s, c):
    v, u = sp.vocabulary(MODEL)
    s = sp.normalised(s)
    n = -(-len(s) // c)
    if not n:
        return []
    parts = [
        sp.Chunk(v, u, s[max(0, i * c - v.longest) : i * c + c + v.longest], min(i * c, v.longest), min(i * c, v.longest) + min(c, len(s) - i * c), i == 0, i == n - 1)
        for i in range(n)
    ]
    states = sp.boundary_states([p.matrix() for p in parts])
    return np.frombuffer(b"".join(p.encode(*s) for p, s in zip(parts, states, strict=True)), "<i4").tolist()


@pytest.mark.parametrize("size", [1, 3, 7, 33, 64])
def test_chunks_give_the_library_ids(library, size):
    for t in texts(800, size):
        assert chunked(t, size) == library.encode(t)


def test_a_giant_word(library):
    r = random.Random(2)
    t = "".join(r.choice("abcdefghinorst") for _ in range(20_000))
    assert chunked(t, 1024) == library.encode(t)


def test_products_are_associative():
    v, u = sp.vocabulary(MODEL)
    s = sp.normalised("internationalization of thethethe words" * 3)
    m = [sp.Chunk(v, u, s[max(0, i - 16) : i + 25], min(i, 16), min(i, 16) + 9, i == 0, False).matrix() for i in (0, 9, 18)]
    assert sp.compose(sp.compose(m[0], m[1]), m[2]) == sp.compose(m[0], sp.compose(m[1], m[2]))


@pytest.mark.parametrize("chunk", [50, 16384])
def test_encode_and_decode_rows(spark, library, chunk):
    rows = [(i, t) for i, t in enumerate(texts(40, 9))] + [(100, None), (101, ""), (None, "no id"), (102, "twice"), (102, "twice"), (103, "word " * 3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sp.encode(d, MODEL, ["doc_id"], chunk=chunk).collect()
    number = lambda i: -1 if i is None else i
    assert sorted((number(r.doc_id), r.ids) for r in got) == sorted((number(i), library.encode(t or "")) for i, t in rows)
    back = sp.decode(sp.encode(d, MODEL, ["doc_id"], chunk=chunk), MODEL, ["doc_id"]).collect()
    want = sorted((-1 if i is None else i, (t or "").replace("▁", " ")) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in back) == want
    trip = sp.round_trip(d, MODEL, chunk=chunk).collect()
    assert all(r.round_trip for r in trip if "▁" not in (dict(rows).get(r.doc_id) or "")) and len(trip) == len(rows)
    assert sp.round_trip(d.limit(0), MODEL).count() == 0
