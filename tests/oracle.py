"""Compare a Spark query with DuckDB SQL: equal columns, and equal rows as a multiset."""

import numbers
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, numbers.Number) or (type(v).__module__ == "numpy" and getattr(getattr(v, "dtype", None), "kind", "") in "iuf" and not getattr(v, "shape", ())):
        v = float(v)
        return "null" if v != v else f"{round(v, 6) + 0.0:.6f}"
    if hasattr(v, "isoformat"):
        return str(v)[:26].replace(" 00:00:00", "")
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([_plain(x) for x in v])
    return str(v)


def rows(frame):
    return sorted(tuple(_plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def check(spark, con, query, sql, sf_dir):
    mine, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
    return len(mine)
