"""A bounded query set scores documents as they pass: pairs of a query and a document are not gathered."""

import random

from docforge.operators import retrieve


def test_pairs_are_not_aggregated(spark):
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["oak", "elm", "ash", "fir", *(f"w{j}" for j in range(30))], k=rng.randint(0, 9)))) for i in range(30)] + [(30, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "oak elm elm"), (2, "zzz"), (3, ""), (4, None)], "item_id long, text string")
    made = retrieve.bm25_top_k(docs, items, 5)
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    for df in (made, retrieve.bm25_scores(docs, items)):  # texts are dealt, not tokens
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        below = [plan[i + 1] for i, line in enumerate(plan) if "RepartitionByExpression" in line]
        assert below and not any("Join" in line or "term" in line for line in below)
    every = {(r["item_id"], r["doc_id"]): r["score"] for r in retrieve.bm25_scores(docs, items).collect()}
    want = []
    for item in (1, 2, 3, 4):
        best = sorted((-round(every.get((item, d), 0.0), 10), d) for d in range(31))[:5]
        want += [(item, d, rank, -score) for rank, (score, d) in enumerate(best, 1)]
    assert sorted((r["item_id"], r["doc_id"], r["rank"], round(r["score"], 10)) for r in made.collect()) == sorted(want)
