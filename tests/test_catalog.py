"""Every registered query of the business operators against its SQL."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tabloom import catalog


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t[:-8]} as select * from read_parquet('{sf}/{t}')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, (int, float)) else str(v)[:10] if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = con.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(tuple(map(plain, r)) for r in x[columns].astype(object).values.tolist()) for x in (got, want)]
    assert rows[0] == rows[1]
