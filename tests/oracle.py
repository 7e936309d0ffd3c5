"""Comparison of a query with its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import math
import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    if hasattr(v, "tolist"):
        return str([norm(x) for x in v.tolist()])
    return str(v)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(norm(v) for v in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


def connect(sf=SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def check(spark, name, query, sql, sf=SF):
    got, want = query(spark, sf).toPandas(), connect(sf).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows_of(got) == rows_of(want), name
