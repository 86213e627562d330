"""Scene sets as Parquet and as array files, and their table."""

import csv
import glob
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeframe.operators import geometry, junctions, stats
from strokeframe.sources import scenes


def drawing(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(6):
        p = rng.integers(0, 200, (4, 2))
        rows += [(c, *p[k], *p[k + 1]) for k in range(3)]
    return np.array(rows, float)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("scenes")
    for k, category in enumerate(["beaches", "cities", "cities"]):
        (at / f"category={category}").mkdir(exist_ok=True)
        a = drawing(k)
        np.save(at / f"category={category}" / f"image {k}.npy", [a, np.asfortranarray(a), a.astype("<f4")][k])
    return str(at)


def test_arrays(spark, folder):
    got = {}
    for r in scenes.read_scene_arrays(spark, folder).collect():
        got.setdefault((r.category, r.image_name), []).append((r.contour_id, r.seg_id, r.x1, r.y1, r.x2, r.y2))
    want = {(c, f"image {k}"): [(int(r[0]), n % 3, *r[1:]) for n, r in enumerate(drawing(k).tolist())] for k, c in enumerate(["beaches", "cities", "cities"])}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    one = scenes.read_scene_arrays(spark, folder, ["beaches"])
    assert {r.image_name for r in one.collect()} == {"image 0"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "category" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_headers():
    for a in (np.arange(6.0).reshape(2, 3), np.zeros((0, 5)), np.asfortranarray(np.arange(8, dtype=">i2").reshape(2, 4)), np.array(3.5)):
        f = io.BytesIO()
        np.save(f, a)
        assert np.array_equal(scenes.parse_array(f.getvalue()), a)
    objects = io.BytesIO()
    np.save(objects, np.array([{}], object), allow_pickle=True)
    f = io.BytesIO()
    np.save(f, np.arange(9))
    for bad in (objects.getvalue(), b"", b"\x93NUMPY", f.getvalue()[:-3], b"\x93NUMPY\x01\x00\x04\x00{x}\n", b"x" * 200):
        with pytest.raises(ValueError):
            scenes.parse_array(bad)


def test_bad_file_names_itself(spark, tmp_path):
    (tmp_path / "category=a").mkdir()
    np.save(tmp_path / "category=a" / "odd.npy", np.zeros((3, 4)))
    with pytest.raises(Exception, match="odd.npy"):
        scenes.read_scene_arrays(spark, str(tmp_path)).collect()


def test_table(spark, folder, tmp_path):
    read = scenes.read_scene_arrays(spark, folder)
    scenes.write_scenes(read, str(tmp_path / "set"))
    again = scenes.read_scenes(spark, str(tmp_path / "set"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, read.collect()))
    assert scenes.read_scenes(spark, str(tmp_path / "set"), ["cities"]).select("category").distinct().count() == 1
    table = scenes.save_scene_table(again, str(tmp_path / "csv"))
    rows = [r for p in sorted(glob.glob(str(tmp_path / "csv/*.csv"))) for r in csv.DictReader(open(p))]
    assert [(r["category"], r["image_name"]) for r in rows] == [("beaches", "image 0"), ("cities", "image 1"), ("cities", "image 2")]
    kept = {r.image_name: r for r in table.collect()}
    for r in rows:
        assert all(math.isclose(float(v), kept[r["image_name"]][k], rel_tol=1e-9, abs_tol=1e-9) for k, v in r.items() if k not in ("category", "image_name"))
    # lengths by hand, between the least and the greatest of all
    lengths = {(k, c): sum(math.hypot(x2 - x1, y2 - y1) for i, x1, y1, x2, y2 in drawing(k) if i == c) for k in range(3) for c in range(6)}
    lo, hi = (math.log10(f(lengths.values()) + 1) for f in (min, max))
    for k in range(3):
        want = [0.0] * 8
        for (d, _), v in lengths.items():
            if d == k:
                want[max(0, min(7, math.floor(round((math.log10(v + 1) - lo) / ((hi - lo) / 8), 9))))] += 10000
        assert [kept[f"image {k}"][f"len_{b + 1}"] for b in range(8)] == pytest.approx(want)
        seg = again.where(F.col("image_name") == f"image {k}").withColumn("drawing_id", F.lit(1).cast("bigint"))
        n = {r.type: r.n for r in junctions.type_counts(junctions.compute(seg)).collect()}
        whole = sum(v for (d, _), v in lengths.items() if d == k)
        assert kept[f"image {k}"]["junc_X"] == pytest.approx(n.get("X", 0) / whole * 10000)
        ori = stats.orientation_stats(geometry.with_properties(seg)).where("contour_id IS NULL").collect()
        assert sum(kept[f"image {k}"][f"ori_{b + 1}"] for b in range(8)) == pytest.approx(sum(r.norm_value for r in ori))
