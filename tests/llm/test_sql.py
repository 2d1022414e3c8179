"""Queries with SQL give what DuckDB gives on the smallest tables, dropped rows and digests included."""

import duckdb
import pytest

from docforge.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in got.description]
    want = sorted(got.fetchall())
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == want
