"""Every registered query of the library beside its SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from lupaspark import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.12g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in plans.ORACLES:
        assert df.columns
        return
    got = duck.execute(plans.ORACLES[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
