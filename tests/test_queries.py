"""Every query with SQL gives the rows that DuckDB gives."""

import os

import pytest
from conftest import TESTDATA

from lodestone.plans import registry

duckdb = pytest.importorskip("duckdb")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    shown = lambda x: repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x)
    return sorted(tuple(shown(x) for x in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(TESTDATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TESTDATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, con, name):
    mine = registry.QUERIES[name](spark, TESTDATA).toPandas()
    theirs = con.execute(registry.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_without_sql(spark, name):
    registry.QUERIES[name](spark, TESTDATA).collect()
