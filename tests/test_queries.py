"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
OWN = [q for q in entry.own.QUERIES if q in entry.own.SQL]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return "" if v is None else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    r = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert [tuple(float(v) if v.replace(".", "").replace("-", "").isdigit() and "." in v else v for v in x) for x in got] == [tuple(float(v) if v.replace(".", "").replace("-", "").isdigit() and "." in v else v for v in x) for x in want]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
