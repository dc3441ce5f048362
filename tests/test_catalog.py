"""Every registered query of the engine against its SQL."""

import os
from datetime import date, datetime
from decimal import Decimal

import pytest

from siltstone.plans import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(x):
    """A value by what it is, whatever its type: whole numbers as int, others to 9 digits, no NaN."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, Decimal)):
        return None if x != x else int(x) if x == int(x) else float(f"{float(x):.9g}")
    if isinstance(x, (datetime, date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return plain(tuple(x.values())) if isinstance(x, dict) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_matches_its_sql(spark, tables, name):
    df, found = catalog.QUERIES[name](spark, SF), tables.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    got = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    at = [found.columns.index(c) for c in columns]
    want = [tuple(plain(r[k]) for k in at) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
