"""Rows of a Spark query against those of DuckDB on the same tables."""

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def assert_same(spark, query, sql, sf_dir=SMALL):
    found = query(spark, sf_dir)
    got_columns, got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    relation = duck(sf_dir).sql(sql)
    want_columns, want = rows_of(relation.columns, relation.fetchall())
    assert got_columns == want_columns
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    want_types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: kinds.get(t, t) for c, t in found.dtypes} == want_types
    assert len(got) == len(want)
    differing = [(a, b) for a, b in zip(got, want) if a != b]
    assert not differing, differing[:3]
