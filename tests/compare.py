"""Order-free comparison of a Spark result with a DuckDB result."""

import math


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return repr([cell(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return order, sorted(tuple(cell(r[i]) for i in at) for r in rows)


def same(frame, con, sql):
    relation = con.sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
