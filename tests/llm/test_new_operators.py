"""Merkle manifest, hard negatives and neighbours against plain versions: nulls, ties, repeated rows, empty tables, other columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeframe.llm import cross_polytope, hard_negatives, merkle, queries
from strokeframe.tables import read_table

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"
VECTORS = "vec_id bigint, embedding array<float>, label int"

# -- op11 ---------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        j = i ^ 1
        yield ("", "") if j >= len(level) else ("<" if j < i else ">", level[j])
        i //= 2


def plain_manifest(rows):
    def leaf(r, n):
        return H(*map(field, (r.doc_id, r.source, r.lang, n, r.text)))

    by = collections.defaultdict(list)
    for r in rows:
        by[r.lang].append((leaf(r, r.n_chars), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for g in langs:
        by[g].sort(key=lambda x: (x[1].doc_id is not None, x[1].doc_id or 0, x[0]))
    trees = {g: levels([x[0] for x in by[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    for k, g in enumerate(langs):
        for i, (h, r) in enumerate(by[g]):
            path = [*siblings(trees[g], i), *siblings(top, k)]
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            x = leaf(r, r.n_chars + 1) if tampered else h
            for side, s in path:
                x = H(s, x) if side == "<" else H(x, s)
            yield r.doc_id, h, trees[g][-1][0], top[-1][0], H(*[s for _, s in path]), x, x == top[-1][0]


ODD_DOCS = [
    (i % 7 or None, "s" if i % 4 else None, ["a", None, "é", "b", ""][i % 5], (1 << 63) - 1 if i == 8 else i if i % 3 else None, None if i % 11 == 0 else "t" * (i % 3) if i % 2 else "ü" * 30_000)
    for i in range(60)
] + [(5, "same", "a", 1, "row")] * 9


@pytest.mark.parametrize("at_once", [10, 2, 1])
def test_manifest(spark, monkeypatch, at_once):
    monkeypatch.setattr(merkle, "LEVELS", at_once)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 16)
    tampers = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))
    for rows in (ODD_DOCS, ODD_DOCS[:1], [(i, "s", "one", i, "t") for i in range(1, 6)]):
        docs = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit(1), "Slot": F.lit(2), "ROOT": F.lit(3)})
        assert sorted(map(tuple, merkle.verify_documents(docs, tampers).collect()), key=repr) == sorted(plain_manifest(docs.collect()), key=repr)


def test_manifest_of_no_rows(spark):
    assert merkle.verify_documents(spark.createDataFrame([], DOCS), F.lit(True)).collect() == []


def test_places_of_equal_rows_are_spread(spark):
    rows = spark.range(3000).select(F.lit(1).alias("k"))
    placed = merkle.numbered(rows, ["k"], 6)
    assert sorted(r.place for r in placed.collect()) == list(range(3000))


# -- op12 and op13 ------------------------------------------------------------


def vector_rows(n=400, seed=1):
    """Clusters with copies, ties, repeated ids, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 8))
    rows = []
    for i in range(n):
        v = centres[i % 5] + 0.4 * rng.normal(size=8)
        rows.append((i, [float(x) for x in (v if i % 9 else np.round(v))], int(i % 4)))
    copy = rows[0][1]
    rows += [(1000 + i, copy, 0) for i in range(60)] + [(50, rows[51][1], 2), (50, rows[51][1], 2), (100, rows[100][1], int(100 % 4)), (None, copy, 0), (None, rows[3][1], 1)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [None] + [1.0] * 7, [1.0, 2.0]]
    rows += [(2000 + 50 * i, v, i % 4) for i, v in enumerate(odd)] + [(2400, copy, None)]
    return rows


def usable(rows, zero_too, unlabelled=False):
    out = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v) or (label is None and not unlabelled):
            continue
        x = np.zeros(8)
        x[: len(v)] = np.array(v, np.float32)
        if zero_too or x.any():
            out.append((i, x, label))
    return out


def last(i):
    return (1 << 63) - 1 if i is None else i


def plain_negatives(rows):
    rows = [(i, np.floor(x * 256), label) for i, x, label in usable(rows, True)]
    for k, (i, a, label) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = [(-int(a @ x), last(j), j, other == label) for m, (j, x, other) in enumerate(rows) if m != k]
        scored.sort(key=lambda s: s[:2])
        for p, _, pid, _ in [s for s in scored if s[3]][:5]:
            fits = [s for s in scored if not s[3] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            for rank, (s, _, nid, _) in enumerate(fits, 1):
                yield i, pid, rank, nid, -p, -s


@pytest.mark.parametrize("leaf,group", [(256, 8192), (8, 64)])
def test_hard_negatives(spark, monkeypatch, leaf, group):
    for name, value in (("LEAF", leaf), ("FANOUT", 3), ("GROUP_ROWS", group), ("GROUP_ANCHORS", group // 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"key": F.lit("x"), "Vector": F.lit(1), "score": F.lit(2)}).repartition(3)
    got = [tuple(r) for r in hard_negatives.mine(df, "vec_id % 50 = 0").collect()]
    assert sorted(got, key=repr) == sorted(plain_negatives(rows), key=repr) and len(got) > 100
    assert hard_negatives.mine(df.limit(0), "vec_id % 50 = 0").collect() == []
    assert hard_negatives.mine(df.where("vec_id = 50"), "vec_id % 50 = 0").collect() == []


def test_boxes_bound_inner_products():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (500, 6))
    tiles = list(hard_negatives._leaf_rows(x.astype(float), np.repeat([1, 2, 3], [300, 197, 3]), [3, 1, 0]))
    assert sorted(np.concatenate(tiles)) == list(range(500)) and max(map(len, tiles)) <= hard_negatives.LEAF


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK_ROWS", 32)
    monkeypatch.setattr(cross_polytope, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(cross_polytope, "RECALL", 1.0)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"key": F.lit("x"), "Vector": F.lit(1), "Score": F.lit(2)})
    known = usable(rows, False, True)
    want = []
    for k, (i, q, _) in enumerate(known):
        if i is not None and i % 20 == 0:
            best = sorted((-(q * x).sum(), last(j), j) for m, (j, x, _) in enumerate(known) if m != k)[:20]
            want += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(best, 1)]
    got = cross_polytope.nearest(df, "vec_id % 20 = 0").collect()
    # RECALL is that of the sample, which has all queries here
    assert sorted((r.query_id, r["rank"], repr(r.vec_id), round(r.score, 9)) for r in got) == sorted((a, b, repr(c), round(d, 9)) for a, b, c, d in want)
    assert cross_polytope.nearest(df.limit(0), "vec_id % 20 = 0").collect() == []
    assert cross_polytope.nearest(df.where("vec_id = 20"), "vec_id % 20 = 0").collect() == []


@pytest.mark.parametrize("dense", [1 << 17, 1])
def test_recall_of_the_query(spark, monkeypatch, dense):
    """One rotation, and two (for buckets with many rows)."""
    monkeypatch.setattr(cross_polytope, "DENSE", dense)
    got = queries.op13_neighbours(spark, DIR).collect()
    table = read_table(spark, DIR, "embeddings").toArrow()
    ids, x = table.column("vec_id").to_numpy(), np.array(table.column("embedding").to_pylist())
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        found = sorted(by[ids[k]])
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(x[ids == f[1]][0] @ x[k] - f[2]) < 1e-9 for f in found)
        hits.append(len({f[1] for f in found} & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert np.mean(hits) >= 0.9


def test_codes_are_the_nearest_signed_axes():
    h = cross_polytope.Hashes(5, 2.0, True, 2)
    x = np.random.default_rng(0).normal(size=(50, 5)) / 3
    units = h.units(x, True)
    assert h.axes == 8 and np.allclose((units**2).sum(axis=1), 1) and np.allclose(h.units(x, False) @ units[0], x @ x[0] / np.linalg.norm(x, axis=1) / 2)
    code = h.codes(units, h.signs())
    for t in range(cross_polytope.TABLES):
        value = h.values(units, h.signs()[t])
        assert (value[np.arange(50), code[:, t]] >= value.max(axis=1) - 1e-12).all()  # two axes may be as near
