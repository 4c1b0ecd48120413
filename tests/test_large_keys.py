"""Queries beside their SQL on tables whose keys are as large as those of sixty copies of sf0.1."""

import datetime

import duckdb
import pytest
from test_queries import plain

from lupaspark import plans

#: Customers of whom eight or seven hex digits of the key's MD5 are the same.
ALIKE = [13914, 135365, 13163, 603725, 9758, 32298, 28553, 30013, 13262, 44345]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Two orders of three lines for each of the customers, in different years of candidacy."""
    folder, con = tmp_path_factory.mktemp("large"), duckdb.connect()
    day = datetime.datetime(1996, 1, 1)
    customers = [(n, f"Customer#{n}", n % 25, 10.0 * (n % 700), ("BUILDING", "MACHINERY")[n % 2]) for n in ALIKE]
    orders = [(i * 1000 + n % 3 * 10 + y, n, "O", 1000.0 + i * 7 + y * (50 if i else -0.1), day, "1-URGENT") for i, n in enumerate(ALIKE) for y in (0, 1)]
    lines = [(o[0], k, (o[0] + 3 * k) % 90, k, 1.0, 20000.0 * (k + 1) + o[0], 0.0, 0.0, "R", "F", day) for o in orders for k in range(3)]
    for name, kinds, rows in (
        ("customer", "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR", customers),
        ("orders", "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR", orders),
        ("lineitem", "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP", lines),
    ):
        con.execute(f"create table {name} ({kinds})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    return str(folder), con


def beside_sql(spark, tables, name):
    """The query's rows and those of its SQL."""
    folder, con = tables
    df = plans.QUERIES[name](spark, folder)
    got = con.execute(plans.ORACLES[name])
    cols = [c[0] for c in got.description]
    return [sorted((tuple(plain(r[cols.index(c)] if not hasattr(r, "asDict") else r[c]) for c in cols) for r in rows), key=repr) for rows in (df.collect(), got.fetchall())]


def test_people_of_large_keys(spark, tables):
    got, want = beside_sql(spark, tables, "d13_people")
    assert got == want and want


def test_names_of_large_keys(spark, tables):
    got, want = beside_sql(spark, tables, "j15_aligned_person")
    assert got == want and want


def test_assets_of_large_keys(spark, tables):
    """The first customer of all loses a ten thousandth, which rounds to nothing below zero."""
    got, want = beside_sql(spark, tables, "d13_assets")
    assert repr(got) == repr(want) and "-0.0" in repr(want)


def test_donors_of_large_keys(spark, tables):
    got, want = beside_sql(spark, tables, "d13_donors")
    assert got == want and want
