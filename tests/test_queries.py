"""Every query against its oracle on the smallest tables."""

from __future__ import annotations

import decimal
import math

import pytest

from trivane import catalog


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([[norm(r[i]) for i in order] for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        return
    want = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, got) == table(names, want.fetchall())


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
