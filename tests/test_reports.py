"""Reports over derived rows: levels of statistics, weeks, coverage, runs that resume, bounded evidence."""

import datetime as dt
import statistics

from pyspark.sql import functions as F

from docforge.operators import reports
from docforge.plans import answer


def test_three_levels_of_chunks(spark):
    rows = [("fixed", d, t, s, n, b) for d, t in ((1, "a"), (2, "a"), (3, "b"), (4, None)) for s, n, b in ((50, 10 * d, "x"), (0, d, "head" if d < 3 else "window"))]
    rows += [("section", 1, "a", 0, 300, "head"), ("section", 1, "a", 9, 600, "x")]
    got = {(r["chunker"], r["doc_type"], r["docs"]): r for r in reports.chunk_report(spark.createDataFrame(rows, "chunker string, doc_id long, doc_type string, start long, tokens long, boundary string")).collect()}
    assert len(got) == 7
    fixed = [r[4] for r in rows if r[0] == "fixed"]
    r = got["fixed", None, 4]
    assert (r["chunks"], r["median_tokens"], r["max_tokens"], r["over_254"], r["boundaries"]) == (8, statistics.median(fixed), 40, 0, "head 2, window 2")
    assert got["fixed", None, 1]["boundaries"] == "window 1"  # the type that is null, not the level above
    r = got[None, None, 5]
    assert (r["chunks"], r["over_510"], r["over_254"], r["boundaries"]) == (10, 1, 2, "head 3, window 2")
    assert got["fixed", "a", 2]["boundaries"] == "head 2"


def test_weeks_and_what_they_cover(spark):
    days = [(dt.date(2024, 1, k), f"t{k}" if k != 3 else None) for k in (1, 2, 3, 7, 8, 14)] + [(None, "x")]
    weeks = reports.week_chunks(spark.createDataFrame(days, "date date, text string"))
    got = {r["week"]: (len(r["days"]), r["text"]) for r in weeks.collect()}
    assert got == {dt.date(2024, 1, 1): (4, "t1\nt2\n\nt7"), dt.date(2024, 1, 8): (2, "t8\nt14")}
    asked = spark.createDataFrame([(1, "d1"), (1, "d2"), (1, "d2"), (1, "d9"), (2, "d1"), (3, "d5")], "item_id int, day string")
    found = spark.createDataFrame([(1, 1, ["d0"]), (1, 2, ["d1", "d2"]), (1, 3, ["d2"]), (1, 4, ["d9"]), (2, 1, ["d1"]), (4, 1, ["d1"])], "item_id int, rank int, days array<string>")
    rows = {r["item_id"]: (r["recall_3"], r["recall_5"], r["mrr"]) for r in reports.coverage(asked, found, (3, 5)).collect()}
    assert rows == {1: (0.6667, 1.0, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0)}


def test_runs_resume(spark):
    planned = spark.createDataFrame([(a, i) for a in "abc" for i in range(3)], "arm string, item long")
    ran = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.0), ("a", 2, None), ("b", 0, 0.5), ("b", 0, 0.5), ("z", 9, 1.0)], "arm string, item long, score double")
    arms, todo = reports.resume(planned, ran)
    assert sorted(tuple(r) for r in arms.collect()) == [("a", 3, 3, "finished", 0.5), ("b", 3, 1, "partial", 0.5), ("c", 3, 0, "not reached", None)]
    assert sorted(tuple(r) for r in todo.collect()) == [("b", 1), ("b", 2), ("c", 0), ("c", 1), ("c", 2)]


def test_evidence_is_bounded(spark):
    rows = spark.createDataFrame([("g", i, f"t{i}") for i in range(40)] + [(None, 1, None), ("h", 2, "same"), ("h", 2, "same")], "g string, i int, t string")
    shown = answer.evidence(rows, "g", F.col("i"), F.col("t"), F.col("i"))
    got = {r["g"]: r for r in shown.collect()}
    assert got["g"]["n"] == 40 and got["g"]["evidence"].endswith("[29]\nt29\n\n---\n\n(10 more matching days not shown)")
    assert got[None]["evidence"] == "[1]\n" and got["h"]["evidence"] == "[2]\nsame\n\n---\n\n[2]\nsame"
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
