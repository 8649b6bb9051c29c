"""The training-data queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from tilewright.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, sf):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want, got = con.sql(ORACLES[name]).df(), QUERIES[name](spark, sf).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(r) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
