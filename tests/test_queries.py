"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tests.conftest import SF
from yxspark.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def base():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, base, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    r = base.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
