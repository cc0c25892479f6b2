"""Every registered query of the library against its SQL on the same tables."""

import duckdb
import pytest

from stellarframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got) >= 1
        return
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = (df[columns].sort_values(columns).reset_index(drop=True) for df in (got, want))
    assert len(a) == len(b)
    for c in columns:
        assert a[c].dtype == b[c].dtype and (a[c] == b[c]).all(), c
