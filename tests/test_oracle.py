"""Every query that has SQL gives DuckDB's rows."""

import math

import pytest

from stratalog.queries import ORACLE, QUERIES


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 8)
    return v.item() if hasattr(v, "item") else v


def rows(cols, data):
    return sorted((tuple(plain(r[c]) for c in cols) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    out = [r.asDict() for r in got.collect()]
    if name not in ORACLE:
        assert out
        return
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    assert rows(sorted(names), out) == rows(sorted(names), want)
