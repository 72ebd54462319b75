"""Every catalog query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from oreline.plans import catalog


def plain(v):
    if pd.isna(v):
        return None
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return int(v)
    return v


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows_of(got) == rows_of(want)
