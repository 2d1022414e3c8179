"""The best rows of each query are kept in the task; pairs are neither sorted nor shuffled."""

import random

import numpy as np
import pyarrow as pa

from docforge.operators import ivf, retrieve
from docforge.operators.batches import Best


def test_best_of_batches_is_best_of_all():
    rng = np.random.default_rng(2)
    scores = np.round(rng.random((5, 300)), 1)
    scores[:, ::7] = -np.inf
    best, held = Best(5, 4), [[] for _ in range(5)]
    for lo in range(0, 300, 32):
        part = scores[:, lo : lo + 32]
        for q, r in zip(*best.take(part, pa.array(range(lo, lo + part.shape[1]))), strict=True):
            held[q].append((-part[q, r], lo + r))
    for q in range(5):
        every = sorted((-s, i) for i, s in enumerate(scores[q]) if s > -np.inf)
        assert sorted(held[q])[:4] == every[:4] and len(held[q]) < len(every)


def vectors(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(300)] + [(900 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.5], 1) for i in range(30)]
    v = spark.createDataFrame([*rows, (990, None, 1), (991, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    return v, v.where("vec_id % 30 = 0 AND vec_id < 990").selectExpr("vec_id AS item_id", "embedding AS qvec")


def ranked(df):
    return sorted((r["item_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_dense_makes_no_pair_rows(spark, monkeypatch):
    v, asked = vectors(spark)
    made = retrieve.dense_top_k(v, asked, 12)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    few = v.where("vec_id < 9 OR vec_id >= 990")
    got, short = ranked(made), [(r["item_id"], r["rank"], r["vec_id"], r["score"]) for r in retrieve.dense_top_k(few, asked, 12).collect()]
    monkeypatch.setattr(retrieve, "BROADCAST_BYTES", -1)
    assert got == ranked(retrieve.dense_top_k(v, asked, 12))
    assert sorted(short, key=lambda r: r[:2]) == sorted(((r["item_id"], r["rank"], r["vec_id"], r["score"]) for r in retrieve.dense_top_k(few, asked, 12).collect()), key=lambda r: r[:2])


def test_cells_make_no_pair_rows(spark, tmp_path):
    v, asked = vectors(spark)
    ivf.write_cells(v, str(tmp_path / "cells"), cells=6)
    made = ivf.probe_top_k(spark, str(tmp_path / "cells"), asked, 5, probes=2, exact=True)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert ranked(made) == ranked(retrieve.dense_top_k(v.where("vec_id < 990"), asked, 5))
