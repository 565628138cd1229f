"""Every registered query of the library against its SQL, on the small tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from floodspark import plans

from .conftest import SMALL

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    """A value without its library's type; numbers as floats, for pandas makes integers with nulls into floats."""
    if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return float(v) if isinstance(v, (int, float, np.number)) else v


def rows(df):
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_others_give_rows(spark, name):
    """Queries that SQL cannot say: their operators are held against brute force in the other tests."""
    assert plans.QUERIES[name](spark, SMALL).count() > 0
