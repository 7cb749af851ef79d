"""The registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

from motifline import catalog_more

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "none"
    return str(value) if isinstance(value, (bool, str)) or type(value).__name__ == "bool_" else repr(float(value))


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog_more.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "orders", "lineitem", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = catalog_more.QUERIES[name](spark, SF), con.sql(catalog_more.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
