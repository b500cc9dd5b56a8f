"""The opN_ queries against their SQL, and op8's two tokenizers against each other, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from quadmill.llm import packing

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", [q for q in entry.oracle_sql() if q not in entry.own.SQL])
def test_llm_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(x[names.index(c)] for c in cols) for x in r.fetchall())
    assert sorted(tuple(x) for x in df.select(*cols).collect()) == want


def test_tokenizers_agree(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    fast, plain = packing.encoder(), Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect() if r.text] + ["ünï çödé 😀", " \t\n", "a  b\r\n c"]
    assert all(fast(t).tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts)
