"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from newsloom.plans import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(y) for y in x]
    if x is None or x is pd.NaT or isinstance(x, float) and np.isnan(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else round(float(x), 6)
    return x.isoformat() if isinstance(x, (datetime.datetime, pd.Timestamp)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([plain(x) for x in r]) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
