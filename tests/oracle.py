"""Runs a query in Spark and its SQL in DuckDB, and compares all values."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0) if value == value else "null"
    return "null" if value is None else str(value)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    have = sorted(tuple(map(_plain, row)) for row in got.select(*(f"`{n}`" for n in names)).collect())
    relation = connect(sf_dir).sql(sql)
    assert sorted(relation.columns) == names
    columns = ", ".join(f'"{n}"' for n in names)
    want = sorted(tuple(map(_plain, row)) for row in relation.project(columns).fetchall())
    assert have == want
