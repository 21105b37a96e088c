import os

import duckdb
import numpy as np
import pytest

from labelweave.plans import relational, relational_more

QUERIES, SQL = relational.QUERIES | relational_more.QUERIES, relational.SQL | relational_more.SQL


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


def _plain(x):
    if x is None or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return float(x) if isinstance(x, (int, float, np.integer, np.floating)) else x


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(map(_plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(SQL))
def test_query_is_its_sql(spark, sf, db, name):
    assert _rows(QUERIES[name](spark, sf).toPandas()) == _rows(db.execute(SQL[name]).df())
