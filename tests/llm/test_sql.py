"""Queries that have DuckDB SQL return its rows."""

import duckdb
import pytest

from emberseal.llm import queries as Q

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{D}/documents.parquet'")
    told = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, D)
    columns = sorted(told.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(told.select(*columns).fetchall())
