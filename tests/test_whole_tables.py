"""Junction classes and pieces of two whole drawings against SQL."""

import duckdb
import pytest

from strokeframe.plans import registry

DIR = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    path = str(tmp_path_factory.mktemp("drawings"))
    spark.read.parquet(f"{DIR}/lineitem.parquet").where("l_orderkey < 150").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.fixture(scope="module")
def con(folder) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    con.execute("CREATE VIEW embeddings AS SELECT 1 AS vec_id, [1.0] AS embedding")
    return con


def test_no_contour_is_left_out(spark, con, folder):
    contours = con.sql(registry.oracle_sql()["contour_length"]).fetchall()
    pieces = registry.queries()["segment_at_junctions"](spark, folder)
    assert pieces.select("contour_id").distinct().count() == len(contours)
    members = registry.queries()["junction_classes"](spark, folder).selectExpr("inline(members)").distinct()
    found = con.sql(registry.oracle_sql()["junction_positions"]).fetchall()
    assert members.count() == len({(r[1], r[2]) for r in found} | {(r[3], r[4]) for r in found})
