"""JSON by column: ragged and missing columns, pages that are missing or shared, maps of objects."""

import json

from docforge.sources import columns


def test_filings_and_pages(spark):
    recent = {"accessionNumber": ["b", "a", "c"], "filingDate": ["2020-01-02", "2020-01-02"], "form": ["10-K", None, "8-K", "extra"]}
    subs = [
        (1, json.dumps({"filings": {"recent": recent, "files": [{"name": "p1"}, {"name": "gone"}]}})),
        (2, json.dumps({"filings": {"recent": {}, "files": [{"name": "p1"}, {"name": "p2"}]}})),
        (3, json.dumps({"filings": {}})), (4, "{}"), (5, None), (6, "torn {"), (7, json.dumps({"filings": {"recent": recent, "files": []}})),
    ]
    pages = [("p1", json.dumps({"accessionNumber": ["z"], "filingDate": ["1999-01-01"], "reportDate": ["1998-12-31"], "primaryDocument": ["z.htm"]})), ("p2", json.dumps({"filingDate": ["2000-01-01"]})), ("p3", json.dumps({"accessionNumber": ["y"]}))]
    got = columns.filings_of(spark.createDataFrame(subs, "cik long, json string"), spark.createDataFrame(pages, "name string, json string"))
    rows = sorted(tuple(r) for r in got.collect())
    own = [("c", None, None, "8-K", None), ("a", "2020-01-02", None, None, None), ("b", "2020-01-02", None, "10-K", None)]
    z = ("z", "1999-01-01", "1998-12-31", None, "z.htm")
    want = {1: [own[0], z, *own[1:]], 2: [z], 7: own}
    assert rows == [(cik, at, *row) for cik, listed in want.items() for at, row in enumerate(listed)]


def test_maps(spark):
    raw = spark.createDataFrame([(json.dumps({"0": {"cik_str": 5, "title": "A", "ticker": "a"}, "x": {"cik_str": 6, "title": "B"}, "y": None}),), ("[]",), ("{",), (None,), ("{}",)], "json string")
    got = columns.map_rows(raw, "cik_str:long,title:string,ticker:string")
    assert sorted(tuple(r) for r in got.collect()) == [(5, "A", "a"), (6, "B", None)]
