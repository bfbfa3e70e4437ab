"""Queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from urlintel.llm.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = duck.sql(oracle_sql()[name])
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
