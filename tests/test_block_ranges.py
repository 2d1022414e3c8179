"""Ranges of a corpus grow with it, so no broadcast holds them."""

from docforge.operators import blockmax


def test_ranges_are_not_broadcast(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b1"), (2, "c3 b2 a")], "item_id long, text string")
    path = str(tmp_path / "blocks")
    blockmax.write_blocks(docs, path, span=4)
    weighted, seen = blockmax.weights(spark, path, items), []
    chosen = blockmax.range_bounds(spark, path, weighted, lambda d: d).where("item_id = 1 OR range % 2 = 0")

    def small(d):
        seen.append(d.columns)
        return d

    rows = blockmax._scores(spark, path, weighted, chosen, small, "doc_id", None).collect()
    assert seen and not [c for c in seen if "range" in c]
    assert {r["doc_id"] for r in rows if r["item_id"] == 1} == set(range(40))
    assert {r["doc_id"] for r in rows if r["item_id"] == 2} < set(range(40))
