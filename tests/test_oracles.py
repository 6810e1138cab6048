"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import os
from collections import Counter

import duckdb
import pytest

from docloom.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if v == v else None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    theirs = Counter(tuple(plain(r[order.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
