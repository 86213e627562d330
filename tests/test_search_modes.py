"""The inverted file, the scan with early exits, starts in parts, and resampling against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeframe.operators import distance, inverted, photo, search
from strokeframe.plans import registry
from strokeframe.plans.fixtures import descriptors

DIR = "/root/testdata/sf0.001"


def plain_neighbours(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 12)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_inverted_file(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 100), ("BLOCK_QUERIES", 60)):
        monkeypatch.setattr(inverted, name, value)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 900)] + 0.2 * rng.normal(size=(900, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_idx bigint, vec array<double>")
    want = plain_neighbours(x, 10)
    few = inverted.exact(vectors, vectors.where("image_idx % 100 = 0"), 10)
    assert {(r.i, r["rank"]): r.j for r in few.collect()} == {(i, n + 1): want[i, n] for i in range(0, 900, 100) for n in range(10)}
    index = inverted.Index.build(vectors, 10)
    assert 0 < index.probes < len(index.centres) == 30
    assert index.lists.count() == 900
    found = {}
    for r in index.search(vectors, 10).collect():
        found.setdefault(r.i, set()).add(r.j)
    assert len(found) == 900 and all(len(v) == 10 for v in found.values())
    assert np.mean([len(found[i] & set(want[i].tolist())) / 10 for i in range(900)]) >= 0.9
    none = vectors.limit(0)
    assert inverted.exact(none, none, 3).count() == 0 and inverted.Index.build(none, 3).search(none, 3).count() == 0


def test_recall_of_the_index_query(spark):
    got, table = {}, descriptors(spark, DIR).toArrow()
    ids, x = table.column("image_idx").to_numpy(), np.array(table.column("vec").to_pylist())
    for r in registry.queries()["knn_index"](spark, DIR).collect():
        got.setdefault(r.i, set()).add(r.j)
    want = plain_neighbours(x, 15)
    assert np.mean([len(got[ids[i]] & set(ids[want[i]].tolist())) / 15 for i in range(len(ids))]) >= 0.9


def test_scan_with_early_exits():
    rng = np.random.default_rng(4)
    differs = 0
    for _ in range(300):
        forth, back = rng.random(40).round(2), rng.random(40).round(2)
        cost, best, at = (forth + back) / 2, np.inf, 0
        for k in range(40):
            if forth[k] >= best or round(cost[k], 9) >= best:
                continue
            best, at = round(cost[k], 9), k
        assert distance.first_in_order(forth, cost) == at
        differs += cost[at] > cost.min() + 1e-9
    assert differs > 10
    assert distance.first_in_order(np.array([np.inf]), np.array([np.inf])) == 0


@pytest.mark.parametrize("n", [7, 230])
def test_starts_in_parts(spark, n):
    rng = np.random.default_rng(n)
    pairs = [(i, j, float(rng.integers(1, 50))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
    members = spark.createDataFrame([(1, i) for i in range(n)] + [(2, 1000)], "collection bigint, image_idx bigint")
    costs = spark.createDataFrame(pairs, "i bigint, j bigint, cost double")
    got = {(r.collection, r.step): r.image_idx for r in search.sequence(members, costs, starts=12, together=5).collect()}
    i, j, c = (np.array(v) for v in zip(*pairs, strict=True))
    d = search.Costs(n, i, j, c, c.sum() + 1.0)
    paths = [search.greedy(d, s) for s in search.spread_starts(n, 12)]
    best = min(paths, key=lambda p: (round(search.total(d, p), 9), p[0]))
    want = search.two_opt(d, best)
    assert [got[1, k] for k in range(n)] == want and got[2, 0] == 1000


@pytest.mark.parametrize("n,to", [(32, 20), (48, 60), (5, 5), (100, 3), (3, 50)])
def test_sinc_weights(n, to):
    got = photo.sinc_weights(n, to)
    assert got.shape == (to, n) and np.allclose(got.sum(axis=1), 1) and np.allclose(got, got[::-1, ::-1], atol=0.02)
    if n == to:
        assert np.allclose(got, np.eye(n), atol=1e-12)
    ramp = got @ np.arange(n)
    assert (np.diff(ramp) > 0).all()


def test_images_of_several_sizes(spark):
    rng = np.random.default_rng(1)
    images = {1: rng.random((30, 70)) * 255, 2: rng.random((9, 5)) * 255}
    rows = [(k, y, x, float(v), float(v) / 2, 255.0) for k, m in images.items() for (y, x), v in np.ndenumerate(m)]
    pix = spark.createDataFrame(rows, "raster_id bigint, y int, x int, r double, g double, b double")
    sizes = spark.createDataFrame([(1, 30, 70), (2, 9, 5), (3, 4, 4)], "raster_id bigint, h int, w int")
    got = {k: np.zeros((16, 12)) for k in (1, 2, 3)}
    for r in photo.resampled(pix, sizes, ["r", "g"], 16, 12, 8).collect():
        got[r.raster_id][r.y, r.x] = r.r
        assert abs(r.g - r.r / 2) < 1e-9
    for k, m in images.items():
        assert np.allclose(got[k], photo.sinc_weights(m.shape[0], 16) @ m @ photo.sinc_weights(m.shape[1], 12).T)
    assert not got[3].any()
    whole = photo.loaded(pix, sizes, 16)
    assert whole.count() == 3 * 256 and whole.where("b <> 1 AND raster_id < 3").count() == 0 and whole.where("NOT (r BETWEEN 0 AND 1)").count() == 0
    assert {(r.raster_id, r.h, r.w) for r in whole.select("raster_id", "h", "w").distinct().collect()} == {(1, 30, 70), (2, 9, 5), (3, 4, 4)}
