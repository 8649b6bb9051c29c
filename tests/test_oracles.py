"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tilewright.catalog import FLAGSHIP, ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, (int, float)) else v


def _rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _rows(got, columns) == _rows(want, columns)


def test_no_oracle_is_left_over():
    assert set(ORACLES) <= set(QUERIES) and FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
