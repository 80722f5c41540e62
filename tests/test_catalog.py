"""Each catalogue query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from plinth.plans import catalog

FOLDER = "/root/testdata/sf0.001"
catalog.load()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if pd.api.types.is_numeric_dtype(df[c]) and df[c].dtype != bool:
            df[c] = df[c].astype(float).round(5)
        else:
            df[c] = df[c].map(lambda v: None if v is None or (np.isscalar(v) and pd.isna(v)) else str(list(v) if isinstance(v, np.ndarray) else v))
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = plain(catalog.QUERIES[name](spark, FOLDER).toPandas()), plain(duck.execute(catalog.SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got:
        if got[c].dtype == float and want[c].dtype == float:
            assert np.isclose(got[c], want[c], rtol=1e-5, atol=1e-5, equal_nan=True).all(), c
        else:
            assert (got[c].fillna("~").astype(str) == want[c].fillna("~").astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
