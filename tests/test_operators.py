"""State machines, planners and edge cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docforge.functions import filters
from docforge.operators import aggregate, chunking, relate, retrieve, store
from docforge.plans import resolver
from docforge.sources.files import VersionedTable, read_jsonl, release_spans, zip_filings
from docforge.sources.html import html_to_text


def test_windows_overlap_by_eighty(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1000))), (2, ""), (3, None)], "doc_id long, text string")
    rows = sorted(chunking.fixed_windows(df).collect())
    assert [(r["win"], r["tokens"]) for r in rows] == [(0, 400), (1, 400), (2, 360)]
    with pytest.raises(ValueError):
        chunking.chunk_rows(df, "other")


def test_index_state_machine(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "ix"))
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    a, b, c = (1, "alpha beta"), (2, "gamma"), (3, "delta")
    assert store.ingest(t, docs(a, b), {"v": 1}) == {"new": 2}
    assert store.ingest(t, docs(a, b), {"v": 1}) == {"unchanged": 2}
    assert store.ingest(t, docs(a, (2, "gamma two"), c), {"v": 1}) == {"unchanged": 1, "changed": 1, "new": 1}
    assert store.ingest(t, docs(a), {"v": 1}) == {"unchanged": 1, "removed": 2}
    assert {r["doc_id"] for r in t.read().collect()} == {1, 2, 3}
    store.ingest(t, docs(a), {"v": 1}, prune=True)
    assert {r["doc_id"] for r in t.read().collect()} == {1}
    hashed = docs(a, b).withColumn("hash", store.content_hash(F.col("text")))
    assert store.status(t.read(), hashed, {"v": 1}, t.stamp())[1] is False
    assert store.status(t.read(), hashed.where("doc_id = 1"), {"v": 1}, t.stamp())[1] is True
    assert store.ingest(t, docs(a, b), {"v": 2}) == {"new": 2}


def test_fusion_order(spark):
    lists = [spark.createDataFrame([(0, k, i) for i, k in enumerate(keys, 1)], "item_id int, doc_id string, rank int") for keys in ("xyw", "yxz")]
    got = [r["doc_id"] for r in retrieve.rrf(lists).orderBy("rank").collect()]
    assert got == ["x", "y", "w", "z"]
    with pytest.raises(ValueError):
        retrieve.search(None, None, mode="none")


def test_zero_scores_fill_up(spark):
    docs = spark.createDataFrame([(1, "apple"), (2, "pear"), (3, ""), (4, "plum plum")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "plum")], "item_id long, text string")
    got = [(r["doc_id"], r["rank"]) for r in retrieve.bm25_top_k(docs, items, 3).orderBy("rank").collect()]
    assert got == [(4, 1), (1, 2), (2, 3)]


def test_plans(spark):
    fields = {"mood": "text", "steps": "number"}
    today = dt.date(2024, 3, 15)
    p = resolver.resolve({"kind": "aggregate", "date_range": {"start": "2024-01-01"}, "date_phrase": "today", "aggregate": {"metric": "steps"}}, fields, today)
    assert p.date_range == ("2024-01-01", None) and p.aggregate["stat"] == "mean"
    assert resolver.resolve({"kind": "filter"}, fields, today).kind == "semantic"
    assert resolver.resolve({"kind": "what"}, fields, today).notes
    p = resolver.resolve({"kind": "filter", "filters": [{"field": "steps", "op": "contains", "value": 3}]}, fields, today)
    assert p.filters == [{"field": "steps", "op": "==", "value": 3}]


def test_empty_match_group_appears(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    got = {r["name"]: (r["n"], r["value"]) for r in aggregate.aggregate(df, "mean", "v", match=F.col("v") > 5).collect()}
    assert got == {"match": (0, None), "all other days": (2, 1.5)}
    with pytest.raises(ValueError):
        filters.typed("v", "number", "~", 1)


def test_nearest_prefers_later_on_ties(spark):
    left = spark.sql("select 1 as id, 9 as cik, date'2024-01-10' as d")
    right = spark.sql("select * from values (9, date'2024-01-08', 'a'), (9, date'2024-01-12', 'b') as t(cik, f, acc)")
    assert [(r["acc"], r["gap_days"]) for r in relate.nearest(left, right, "cik", "d", "f", ["acc"]).collect()] == [("b", 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2')
    good, bad = read_jsonl(spark, str(tmp_path / "p.jsonl"), "a int")
    assert [r["a"] for r in good.collect()] == [1] and bad.count() == 2
    rel = spark.createDataFrame([("t", "hello world", [("t__Parties", "?", [("world", 6), ("nope", 0)])])], "title string, context string, qas array<struct<id string, question string, answers array<struct<text string, answer_start int>>>>")
    assert sorted((r["category"], r["start"], r["mapped"]) for r in release_spans(rel).collect()) == [("Parties", 0, False), ("Parties", 6, True)]
    blocks = spark.createDataFrame([(1, ["x", "y"], ["10-K", None])], "cik int, acc array<string>, form array<string>")
    assert len(zip_filings(blocks, ["acc", "form", "missing"]).collect()) == 2
    page = spark.createDataFrame([("<p>a&amp;b</p><script>x='</p>'</script><div>c</div>",)], "html string")
    assert page.select(html_to_text(F.col("html"))).first()[0].split() == ["a&b", "c"]


def test_core_does_not_import_llm():
    import pathlib

    import docforge

    root = pathlib.Path(docforge.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "docforge.llm" in p.read_text()]
