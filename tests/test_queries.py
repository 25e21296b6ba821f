"""Every query against its SQL, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from gridlake import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, con, sf, name):
    df = q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name not in q.SQL:
        assert ours
        return
    rel = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({q.SQL[name]})")
    theirs = sorted(tuple(map(plain, r)) for r in rel.fetchall())
    assert ours == theirs
    types = {c.lower(): t for c, t in zip(cols, [x[1] for x in con.execute(f"describe select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({q.SQL[name]})").fetchall()])}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = {c: (t, types[c.lower()]) for c, t in df.dtypes if same[t] != types[c.lower()]}
    assert not wrong


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
