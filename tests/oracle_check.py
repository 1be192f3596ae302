"""Compare a query with its SQL counterpart, rows as a bag and columns by name."""

import math
from pathlib import Path

import duckdb

DIRECTORY = Path("/root/testdata/sf0.001")


def connected():
    connection = duckdb.connect()
    for file in DIRECTORY.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def same_rows(spark, query, sql):
    df = query(spark, str(DIRECTORY))
    columns = sorted(df.columns)
    ours = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    theirs = connected().sql(sql)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    rows = [tuple(_plain(r[i]) for i in at) for r in theirs.fetchall()]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(ours, key=key) == sorted(rows, key=key)
