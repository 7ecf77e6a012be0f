"""Order-insensitive comparison of a Spark query with its SQL."""

from __future__ import annotations

from pyspark.sql import Row


def plain(v):
    if isinstance(v, Row):
        return plain(v.asDict())
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return repr(v)


def assert_same(df, con, sql):
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(names)
    a, b = sorted(df.columns), sorted(range(len(names)), key=lambda i: names[i])
    left = sorted(tuple(plain(r[c]) for c in a) for r in df.collect())
    right = sorted(tuple(plain(r[i]) for i in b) for r in got.fetchall())
    assert left == right
