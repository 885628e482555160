"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from wedgeworks import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    want = sql.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered([tuple(r) for r in got.collect()], got.columns) == ordered(want.fetchall(), want.columns)
