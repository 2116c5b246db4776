"""Every core query against its SQL on the smallest tables, as the driver compares them."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from factloom.plans import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def text(x) -> str:
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, (bool, str)):
            return str(x)
        try:
            return repr(round(float(x), 6))
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(text(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
