"""Compare a query with its SQL on DuckDB, as multisets of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(x) if isinstance(x, float) else str(x) for x in row) for row in frame.astype(object).where(frame.notna(), None).values.tolist())


def same(query, sql, spark, sf):
    ours, theirs = query(spark, sf).toPandas(), connect(sf).execute(sql).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
    return ours
