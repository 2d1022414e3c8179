"""What holds at size: the paths beyond a broadcast, medians by ranks, phrases by key."""

import random
import re
import statistics

import pyarrow as pa
import pytest

from docforge.operators import aggregate, evaluate, retrieve


@pytest.fixture
def corpus(spark):
    rng = random.Random(5)
    words = ["oak", "elm", "ash", "fir", "yew", "bay"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(40)] + [(40, None), (41, "oak  elm\nash"), (42, "xoak elm ashy")]
    items = [(0, "oak elm"), (1, "elm ash fir"), (2, "zzz"), (3, "oak elm ash"), (4, ""), (5, "fir fir")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_shuffled_queries_give_what_broadcast_ones_give(corpus, monkeypatch):
    docs, items, *_ = corpus
    vectors = docs.selectExpr("doc_id AS vec_id", "array(cast(doc_id + 1 AS float), cast(7 AS float), cast(doc_id % 5 AS float)) AS embedding")
    asked = vectors.where("vec_id % 3 = 0").selectExpr("vec_id AS item_id", "embedding AS qvec")
    made = [
        lambda: retrieve.bm25_top_k(docs, items, 4), lambda: retrieve.hash_scores(docs, items), lambda: retrieve.search(docs, items, 3, "hybrid", rerank=True),
        lambda: evaluate.gold_spans(docs, items), lambda: retrieve.dense_top_k(vectors, asked, 3, block=4),
    ]
    small = [rows(f()) for f in made]
    monkeypatch.setattr(retrieve, "BROADCAST_BYTES", -1)
    assert [rows(f()) for f in made] == small
    assert all(small)


def test_phrases_by_key_are_all_places(corpus):
    docs, items, texts, phrases = corpus
    want = []
    for item, phrase in phrases:
        if phrase:
            pattern = re.compile(r"\s+".join(phrase.split()), re.I)
            want += [(item, doc, *m.span()) for doc, text in texts for m in pattern.finditer(text or "")]
    assert rows(evaluate.gold_spans(docs, items)) == sorted(want)


def test_filtered_ranks_keep_the_statistics_of_all(corpus):
    docs, items, *_ = corpus
    every = {(r["item_id"], r["doc_id"]): round(r["score"], 9) for r in retrieve.bm25_scores(docs, items).collect()}
    some = {(r["item_id"], r["doc_id"]): round(r["score"], 9) for r in retrieve.bm25_scores(docs, items, allowed=docs["doc_id"] < 9).collect()}
    assert some and some == {k: v for k, v in every.items() if k[1] < 9}


def test_kept_postings_score_alike(spark, corpus, tmp_path):
    docs, items, *_ = corpus
    retrieve.write_postings(docs, str(tmp_path / "index"), buckets=8)
    kept = retrieve.kept_scores(spark, str(tmp_path / "index"), items)
    assert rows(kept) == rows(retrieve.bm25_scores(docs, items))
    again = retrieve.kept_scores(spark, str(tmp_path / "index"), items.where("item_id = 2"))
    assert rows(again) == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 5000])
def test_medians(spark, n):
    rng = random.Random(n)
    data = [(None if i % 97 == 96 else "ab"[i % 2], None if i % 11 == 10 else float(rng.choice([rng.gauss(0, 1), 0, 1, 1, 2]))) for i in range(n)]
    got = {r["name"]: (r["n"], r["value"]) for r in aggregate.aggregate(spark.createDataFrame(data, "g string, v double"), "median", "v", "g").collect()}
    want = {}
    for g in {g for g, _ in data}:
        own = [v for k, v in data if k == g]
        real = [v for v in own if v is not None]
        want[g] = (len(own), statistics.median(real) if real else None)
    assert got == want


def test_medians_of_sides_and_of_all(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 8.0), (3, 1.0), (4, float("nan"))], "day int, v double")
    assert {r["name"]: (r["n"], r["value"]) for r in aggregate.aggregate(df, "median", "v", match=df["day"] < 3).collect()}["match"] == (2, 6.0)
    assert [tuple(r) for r in aggregate.aggregate(df, "median", "v").collect()] == [("all matching days", 4, 6.0)]


def test_bounded_queries_let_out_only_what_may_be_best(spark, corpus):
    docs, items, *_ = corpus
    assert "MapInArrow" in retrieve.hash_top_k(docs, items, 2)._jdf.queryExecution().optimizedPlan().toString()
    want = retrieve.top_k(retrieve.hash_scores(docs, items), 2)
    assert rows(retrieve.hash_top_k(docs, items, 2)) == rows(want)


def test_sparse_vectors_across_batches_and_signs(spark):
    rng = random.Random(3)
    vectors = {i: {s: rng.choice((1.0, 2.0, -1.0, 0.0)) for s in rng.sample(range(9), rng.randint(1, 6))} for i in range(60)}
    asked = {7: {0: 1.0, 3: 2.0}, 8: {1: 1.0}}
    flat = pa.table({"doc_id": [i for i, v in vectors.items() for _ in v], "slot": [s for v in vectors.values() for s in v], "value": [x for v in vectors.values() for x in v.values()]})
    weights = pa.table({"item_id": [i for i, v in asked.items() for _ in v], "slot": [s for v in asked.values() for s in v], "w": [x for v in asked.values() for x in v.values()]})
    for size in (1, 4, 1000):
        task, kind = retrieve.sparse_task(weights, "bigint", 9, 100, "doc_id")
        got = sorted((r["item_id"], r["doc_id"], r["score"]) for b in task(iter(flat.to_batches(max_chunksize=size))) for r in b.to_pylist())
        assert kind == "bigint" and got == sorted((i, d, sum(w * v.get(s, 0) for s, w in q.items())) for i, q in asked.items() for d, v in vectors.items() if q.keys() & v.keys())
