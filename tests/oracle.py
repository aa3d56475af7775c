"""Compares a query with its SQL on the driver's small tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(columns, values):
    """Rows with columns by name, in an order of their own; floats as they are, counts as integers."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(None if v is None or v != v else v) for v in (r[k] for k in order)) for r in values)


def assert_same(spark, query, sql):
    got = query(spark, DIR)
    con = connection()
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
