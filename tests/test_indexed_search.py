"""Searches over kept blocks and cells give what full scans give, and read less."""

import random

import numpy as np
import pytest

from docforge.functions import filters
from docforge.operators import blockmax, ivf, retrieve


def topics(n, seed=3):
    """Documents of a topic a hundred in id order, with some words of all topics."""
    rng = random.Random(seed)
    return [(i, " ".join(f"t{i // 100}w{rng.randrange(30)}" if rng.random() < 0.7 else f"common{rng.randrange(20)}" for _ in range(rng.randint(5, 40))), "a" if i % 3 else "b") for i in range(n)]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rows = [*topics(1000), (5000, None, "a"), (5001, "", "b"), (5002, "!!", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    path = str(tmp_path_factory.mktemp("blocks") / "index")
    blockmax.write_blocks(docs, path, span=32)
    items = spark.createDataFrame([(1, "t3w1 t3w2 t3w2 common1"), (2, "t7w5"), (3, "nothing of it"), (4, "t1w1 t8w2 common3 common4"), (5, None), (6, "common0")], "item_id long, text string")
    return docs, path, items


def ranked(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 10, 40])
@pytest.mark.parametrize("where", [None, {"source": "b"}])
def test_blocks_give_the_full_scan(spark, kept, k, where):
    docs, path, items = kept
    allowed = filters.metadata(where) if where else None
    assert ranked(blockmax.kept_top_k(spark, path, items, k, allowed)) == ranked(retrieve.bm25_top_k(docs, items, k, allowed))


def test_fewer_blocks_are_read(spark, kept):
    _, path, items = kept
    bounds, need, _ = blockmax.chosen_ranges(spark, path, items.where("item_id IN (1, 2, 4)"), 3)
    every, read = (d.agg({"blocks": "sum"}).first()[0] for d in (bounds, need))
    assert read < every / 3


def test_bounds_hold(spark, kept):
    docs, path, items = kept
    bounds = {(r["item_id"], r["range"]): r["bound"] for r in blockmax.range_bounds(spark, path, blockmax.weights(spark, path, items), lambda d: d).collect()}
    of = {r["doc_id"]: r["range"] for r in spark.read.parquet(f"{path}/documents").collect()}
    for r in retrieve.bm25_scores(docs, items).collect():
        assert r["score"] <= bounds[r["item_id"], of[r["doc_id"]]] + 1e-9


def test_terms_in_most_documents_and_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b" if i else "a c") for i in range(5)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "b c"), (3, "c a a")], "item_id long, text string")
    blockmax.write_blocks(docs, str(tmp_path / "few"), span=2)
    assert ranked(blockmax.kept_top_k(spark, str(tmp_path / "few"), items, 5)) == ranked(retrieve.bm25_top_k(docs, items, 5))
    blockmax.write_blocks(docs.where("false"), str(tmp_path / "none"))
    assert blockmax.kept_top_k(spark, str(tmp_path / "none"), items, 3).count() == 0


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 12))
    x = centre[rng.integers(20, size=900)] + 0.15 * rng.normal(size=(900, 12))
    rows = [(i, v, i % 4) for i, v in enumerate(x.tolist())]
    rows += [(9000 + i, x[3].tolist(), None) for i in range(40)]
    rows += [(9100, None, 1), (9101, [0.0] * 12, 1), (9102, [1.0] * 11, 1), (9103, [float("nan")] * 12, 1), (9104, [float("inf")] * 12, 1), (None, x[4].tolist(), 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    path = str(tmp_path_factory.mktemp("cells") / "index")
    ivf.write_cells(vectors, path, cells=20)
    asked = vectors.where("vec_id % 50 = 0 AND vec_id < 9000").selectExpr("vec_id AS item_id", "embedding AS qvec")
    good = vectors.where("vec_id < 9100 OR vec_id IS NULL")
    return path, asked, good


def vecs(df):
    return sorted((r["item_id"], r["rank"], r["vec_id"] or -1, round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("probes", [1, 4])
def test_cells_exact_equals_all_pairs(spark, cells, probes):
    path, asked, good = cells
    assert vecs(ivf.probe_top_k(spark, path, asked, 10, probes=probes, exact=True)) == vecs(retrieve.dense_top_k(good, asked, 10))


def test_probes_reach_nine_tenths_and_read_less(spark, cells):
    path, asked, good = cells
    want = retrieve.dense_top_k(good, asked, 10)
    assert ivf.recall(ivf.probe_top_k(spark, path, asked, 10, probes=3), want).agg({"recall": "avg"}).first()[0] >= 0.9
    kept = spark.read.parquet(f"{path}/vectors")
    assert kept.count() == good.count()
    assert ivf.probe_top_k(spark, path, asked.selectExpr("item_id", "transform(qvec, x -> 0D) AS qvec"), 3).count() == 0


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    ivf.write_cells(none, str(tmp_path / "x"))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "item_id long, qvec array<double>")
    assert ivf.probe_top_k(spark, str(tmp_path / "x"), asked, 3, exact=True).count() == 0
