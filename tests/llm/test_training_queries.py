import os

import pytest
from conftest import TESTDATA

from lodestone.llm import queries as Q

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    mine = Q.QUERIES[name](spark, TESTDATA)
    rows = [tuple(r[c] for c in sorted(mine.columns)) for r in mine.collect()]
    if name not in Q.SQL:
        return
    con = duckdb.connect()
    for f in os.listdir(TESTDATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TESTDATA}/{f}'")
    cur = con.execute(Q.SQL[name])
    names = [d[0] for d in cur.description]
    theirs = [tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(names) == sorted(mine.columns) and sorted(map(repr, rows)) == sorted(map(repr, theirs))
