"""Holds a query's rows against its DuckDB SQL, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    return v


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.sql(sql)
    at = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return [got.columns[i] for i in at], sorted((tuple(_plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if equal, else what differs first."""
    names, ours = rows_of_spark(df)
    their_names, theirs = rows_of_sql(con, sql)
    if names != their_names:
        return f"columns {names} and {their_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    return next((f"{a} and {b}" for a, b in zip(ours, theirs, strict=True) if a != b), "")
