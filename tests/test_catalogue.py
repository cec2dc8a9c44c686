"""Every catalogue query against its SQL."""

import glob
import math
import os

import duckdb
import pytest

from claimlattice import plans

from .conftest import SF

plans.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return (0, "")
    return (1, f"{float(x):.3f}") if isinstance(x, (int, float)) and not isinstance(x, bool) else (1, str(x))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in plans.SQL:
        assert rows
        return
    cur = duck.execute(plans.SQL[name])
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    a = sorted(tuple(cell(r[c]) for c in sorted(names)) for r in rows)
    b = sorted(tuple(cell(v) for _, v in sorted(zip(names, r))) for r in theirs)
    assert len(a) == len(b)
    assert a == b
