"""The store by buckets: only touched files change, replays and stopped writers do no harm; streams; close names with bounds."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from docforge.operators import bucketed, relate
from docforge.operators.bucketed import BucketStore
from docforge.operators.chunking import chunk_rows
from docforge.streaming.ingest import ingest_stream

WORDS = " ".join(f"w{i}" for i in range(900))
ROWS = [(i, f"{i} {WORDS[: 37 * i % 3000]}", "a") for i in range(12)] + [(50, None, "a"), (51, "", "b")]
SCHEMA = "doc_id long, text string, kind string"


def held(store):
    return sorted((r["doc_id"], r["chunk_id"], r["text"]) for r in store.chunks().collect())


def wanted(spark, rows, chunker="fixed"):
    made = chunk_rows(spark.createDataFrame(rows, SCHEMA), chunker)
    return sorted((r["doc_id"], r["chunk_id"], r["text"]) for r in made.collect())


def test_states_of_a_store(spark, tmp_path):
    store, other = BucketStore(spark, str(tmp_path / "s"), digits=1), BucketStore(spark, str(tmp_path / "s"), "section", digits=1)
    one = spark.createDataFrame(ROWS, SCHEMA)
    assert store.ingest(one, {"v": 1}) == {"new": 14, "changed": 0, "unchanged": 0, "rebuilt": True, "reasons": ["no store yet"], "buckets": 9}
    assert held(store) == wanted(spark, ROWS)
    assert other.ingest(one, {"v": 1})["new"] == 14  # another chunker is another store
    assert held(other) == wanted(spark, ROWS, "section")
    before = store.files()
    assert store.ingest(one, {"v": 1}) == {"new": 0, "changed": 0, "unchanged": 14, "rebuilt": False, "reasons": [], "buckets": 0}
    assert store.files() == before
    # one text, one other column, one gone, one new; documents that are not given stay without prune
    two = [(i, "amended" if i == 3 else t, "b" if i == 4 else k) for i, t, k in ROWS if i != 5] + [(70, "fresh", None)]
    report = store.ingest(spark.createDataFrame(two, SCHEMA), {"v": 1})
    assert (report["new"], report["changed"], report["unchanged"]) == (1, 2, 11) and "removed" not in report
    assert held(store) == wanted(spark, [*two, ROWS[5]])
    touched = {r[0] for r in spark.createDataFrame([(3,), (4,), (70,)], "d long").select(bucketed.bucket_of(F.col("d"), 1)).collect()}
    now = store.files()
    assert {b for b in {*before, *now} if before.get(b) != now.get(b)} == touched
    report = store.ingest(spark.createDataFrame(two, SCHEMA), {"v": 1}, prune=True)
    assert (report["removed"], report["buckets"]) == (1, 1)
    assert held(store) == wanted(spark, two)
    # a bucket that loses its last document, or whose documents lose their text
    rest = [(i, None if i < 6 else t, k) for i, t, k in two if i not in (8, 9, 10, 11)]
    store.ingest(spark.createDataFrame(rest, SCHEMA), {"v": 1}, prune=True)
    assert held(store) == wanted(spark, rest)
    assert store.docs().count() == len(rest)
    report = store.ingest(spark.createDataFrame(rest[:2], SCHEMA), {"v": 2})
    assert report["rebuilt"] and report["reasons"] == ["v: index has 1, code has 2"]
    assert held(store) == wanted(spark, rest[:2])


def test_after_a_writer_that_stopped(spark, tmp_path, monkeypatch):
    store = BucketStore(spark, str(tmp_path / "s"), digits=1)
    store.ingest(spark.createDataFrame(ROWS, SCHEMA), {"v": 1})
    two = [(i, f"second {t}" if i in (1, 2) else t, k) for i, t, k in ROWS]
    whole = BucketStore._replace

    def stops(self, name, df, fresh):
        if name == "docs":
            raise OSError("stopped")
        whole(self, name, df, fresh)

    monkeypatch.setattr(BucketStore, "_replace", stops)
    with pytest.raises(OSError):
        store.ingest(spark.createDataFrame(two, SCHEMA), {"v": 1})
    monkeypatch.setattr(BucketStore, "_replace", whole)
    assert store.ingest(spark.createDataFrame(two, SCHEMA), {"v": 1})["buckets"] > 0
    assert held(store) == wanted(spark, two)
    assert store.ingest(spark.createDataFrame(two, SCHEMA), {"v": 1})["buckets"] == 0


def test_stream_and_its_replay(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), digits=1)
    feed = str(tmp_path / "feed")
    spark.createDataFrame(ROWS[:6], SCHEMA).write.parquet(feed)
    docs = spark.readStream.schema(SCHEMA).parquet(feed)
    ingest_stream(docs, store, {"v": 1}, str(tmp_path / "c1")).awaitTermination()
    assert held(store) == wanted(spark, ROWS[:6])
    before = store.files()
    # a lost checkpoint runs the same batch again
    ingest_stream(docs, store, {"v": 1}, str(tmp_path / "c2")).awaitTermination()
    assert store.files() == before
    spark.createDataFrame([(1, "changed", "a"), (99, "new", "a"), (99, "new", "a")], SCHEMA).write.mode("append").parquet(feed)
    ingest_stream(docs, store, {"v": 1}, str(tmp_path / "c1")).awaitTermination()
    assert held(store) == wanted(spark, [ROWS[0], (1, "changed", "a"), *ROWS[2:6], (99, "new", "a")])


def close_names(key, ids, top=3, least=0.85):
    """The library's own search among names of one prefix, as the rule says."""
    if len(key) < 5:
        return []
    near = difflib.get_close_matches(key, [k for k in ids if k[:3] == key[:3]], n=top, cutoff=least)
    return [(key, k, min(ids[k]), round(difflib.SequenceMatcher(None, key, k).ratio(), 4)) for k in near if len(ids[k]) == 1]


def test_close_names_with_bounds(spark):
    rng = random.Random(6)
    stems = ["acmewidgets", "acmwidgetsnorth", "acquireholdings", "acmebrothers"]
    spoil = lambda w: "".join(c if rng.random() > 0.12 else rng.choice(["", c + c, rng.choice("aeinst"), "é"]) for c in w)
    ids = {}
    for i in range(300):
        ids.setdefault(spoil(rng.choice(stems)), set()).add(i % 170)
    asked = sorted({spoil(rng.choice(stems)) for _ in range(60)} | {"acme", "acm", ""})
    names = spark.createDataFrame([(k, c) for k, cs in ids.items() for c in cs], "key string, cik long")
    left = spark.createDataFrame([(k,) for k in asked], "key string")
    got = sorted((r["key"], r["other"], r["cik"], r["score"]) for r in relate.fuzzy_match(left, names).collect())
    assert got == sorted(row for k in asked for row in close_names(k, ids))
    pairs = relate.fuzzy_pairs(left, names.select(F.col("key").alias("other")).distinct(), 0.85).count()
    crossed = sum(1 for k in asked if len(k) >= 5 for o in ids if o[:3] == k[:3])
    assert pairs < crossed / 2
