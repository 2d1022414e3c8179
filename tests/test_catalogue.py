"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pytest

from docforge.plans import catalogue, reports, selection  # noqa: F401  the others register their queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return repr(round(v, 5)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = duck.execute(catalogue.ORACLES[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


def test_fuzzy_scores_are_high_and_blocked(spark):
    rows = catalogue.QUERIES["name_fuzzy_block"](spark, DIR).collect()
    assert rows
    assert all(r["score"] >= 0.85 and r["key"][:3] == r["other"][:3] for r in rows)
