"""Runs a query's SQL in DuckDB over the same tables and compares rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else f"{value + 0.0:.9g}")
    if isinstance(value, (list, tuple)):
        return (2, tuple(map(_key, value)))
    return (1, str(value))


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_key(r[i]) for i in order) for r in rows)


def _near(a, b):
    """Equal, or floats within what rounding at six places can differ by."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 2e-6 * max(1.0, abs(a))
    return _key(a) == _key(b)


def assert_same(df, sql, sf_dir):
    names, rows = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)

    def ordered(table):
        plain = lambda r: tuple(_key(x) for x in r if not isinstance(x, float))
        return sorted(table, key=lambda r: (plain(r), tuple(round(x, 3) for x in r if isinstance(x, float) and not math.isnan(x)), tuple(x for x in r if isinstance(x, float))))

    got = ordered([tuple(r[c] for c in columns) for r in df.collect()])
    want = ordered([tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in rows])
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert all(map(_near, a, b)), (columns, a, b)
