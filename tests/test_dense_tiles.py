"""Dense tiles: which are kept, at the limit and on a whole table, against a plain version and the query's SQL."""

from collections import Counter

from oracle import connect, difference

from strokeframe.plans import registry

NAME = "tile_density_filter"
DIR = "/root/testdata/sf0.001"
LEAST = 0.1 * 24 * 24


def planted(raster: int, y: int, x: int) -> tuple:
    """A line item whose pixel is at (y, x) of ``raster``, with strength 0.8."""
    part = (x - 24) * 35 % 48
    return (1, part, raster, (y - 7 * part) * 13 % 32, 40.0, 1.0)


def test_a_tenth_of_strong_pixels_is_enough(spark, tmp_path):
    places = [(y, x) for y in range(8, 24) for x in range(4)]
    rows = [planted(raster, y, x) for raster, n in ((1, 58), (2, 57), (3, 1)) for y, x in places[:n]]
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.queries()[NAME](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(1, ty, 0, 24, 58, 46.4) for ty in (0, 4, 8)]


def test_tiles_of_a_whole_table(spark):
    pixels = {}
    for raster, part, line, quantity in spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_linenumber", "l_quantity").collect():
        at = (raster, (part * 7 + line * 5) % 32, (part * 11 + int(quantity) * 3) % 48)
        pixels[at] = max(pixels.get(at, 0), quantity)
    count = Counter((k, ty, tx) for (k, y, x), q in pixels.items() if q > 30 for ty in range(0, 9, 4) for tx in range(0, 25, 4) if 0 <= y - ty < 24 and 0 <= x - tx < 24)
    expected = {(*tile, n) for tile, n in count.items() if n >= LEAST}
    found = registry.queries()[NAME](spark, DIR)
    assert expected and {(r.raster_id, r.ty, r.tx, r.n) for r in found.collect()} == expected
    assert not difference(found, connect(DIR), registry.oracle_sql()[NAME])
