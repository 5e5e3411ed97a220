"""Every query with a statement in SQL gives the rows that DuckDB gives, at the smallest scale."""

import os

import duckdb
import numpy as np
import pytest

from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        df[c] = df[c].map(lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x))
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
