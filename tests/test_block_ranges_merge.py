"""What grows with a corpus passes no driver, and tokens of a range move once."""

from pyspark.sql import functions as F

from docforge.operators import blockmax


def test_joins_by_range_stay_off_the_driver(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}", f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "a b1"), (2, "c3 b2 a")], "item_id long, text string")
    path = str(tmp_path / "blocks")
    blockmax.write_blocks(docs, path, span=4)
    weighted = blockmax.weights(spark, path, items)
    chosen = blockmax.range_bounds(spark, path, weighted, F.broadcast)
    made = blockmax._scores(spark, path, weighted, chosen, F.broadcast, "doc_id", F.col("source") == "s1")
    rows = made.collect()
    final = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin [range" not in final and final.count("SortMergeJoin [range") == 2
    assert {r["doc_id"] for r in rows if r["item_id"] == 1} == set(range(1, 40, 2))


def test_tokens_of_a_range_move_once(spark, tmp_path):
    kept = spark.createDataFrame([(i, i // 4, 2, ["a", f"b{i % 3}"]) for i in range(12)], "doc_id long, range long, dl int, tokens array<string>")
    made = blockmax._made(kept.repartition(3, "range"), kept.agg(F.avg("dl").alias("avgdl")), "doc_id")
    assert {(r["range"], r["term"]): r["n"] for r in made.collect()}[(1, "a")] == 4
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(range") == 1
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "term" in x]
