"""Registered queries against their SQL."""

import duckdb
import pytest

from gridlake.llm import queries as q

TABLES = ("documents", "embeddings", "conversations")


@pytest.mark.parametrize("name", list(q.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    df = q.QUERIES[name](spark, "/root/testdata/sf0.01")
    cols = sorted(df.columns)
    ours = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert ours == sorted(map(str, con.execute(f"select {', '.join(cols)} from ({q.SQL[name]})").fetchall()))


def test_names():
    assert [n.split("_")[0] for n in q.QUERIES] == [f"op{i}" for i in range(1, 14)]
