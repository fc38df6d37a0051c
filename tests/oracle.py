"""Compare a Spark result with a DuckDB statement over the same tables."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata"


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/sf{sf}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, round(float(value), 4) + 0.0)
    return (3, str(value))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: tuple(_key(v) for v in r))


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=0)
    return type(a) is type(b) and a == b


def difference(df, con, sql):
    """None if equal, else a short account."""
    got_columns = df.columns
    got = rows(got_columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_columns = [c[0] for c in cursor.description]
    want = rows(want_columns, cursor.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({sorted(got_columns)}): {bad[:3]}"
    return None
