"""Date phrases, plans, filters and answers on written cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docforge.functions import filters
from docforge.functions.text import numbers_in
from docforge.plans import answer, phrases, resolver

TODAY = dt.date(2024, 3, 15)
CASES = {
    "today": "2024-03-15 2024-03-15", "Yesterday?": "2024-03-14 2024-03-14", "this week": "2024-03-11 2024-03-15", "last week": "2024-03-04 2024-03-10",
    "this month": "2024-03-01 2024-03-15", "last month": "2024-02-01 2024-02-29", "past 3 days": "2024-03-13 2024-03-15", "in the last two weeks": "2024-03-02 2024-03-15",
    "previous couple of months": "2024-01-16 2024-03-15", "the first two weeks of June": "2023-06-01 2023-06-14", "second half of February": "2024-02-16 2024-02-29",
    "last 10 days of January 2023": "2023-01-22 2023-01-31", "second week of march": "2024-03-08 2024-03-14", "the week of March 4": "2024-03-04 2024-03-10",
    "from 3/1 to 3/5": "2024-03-01 2024-03-05", "between June 9 and June 2, 2022": None, "between June 9th, 2022 and June 2, 2022": "2022-06-02 2022-06-09", "in August": "2023-08-01 2023-08-31",
    "April 2022": "2022-04-01 2022-04-30", "end of February": "2024-02-23 2024-02-29", "beginning of jan 2021": "2021-01-01 2021-01-07", "June 14": "2023-06-14 2023-06-14",
    "3/4/24": "2024-03-04 2024-03-04", "2024-2-30": None, "blue": None, "": None,
}


def test_phrases(spark):
    df = spark.createDataFrame([(p,) for p in CASES] + [(None,)], "p string")
    got = {r[0]: r[1] and f"{r[1]['lo']} {r[1]['hi']}" for r in df.select("p", phrases.phrase_range(F.col("p"), F.lit(TODAY))).collect()}
    want = dict(CASES) | {None: None, "between June 9 and June 2, 2022": "2022-06-02 2023-06-09"}
    assert got == want
    assert phrases.resolve_phrase("yesterday", TODAY) == (dt.date(2024, 3, 14),) * 2


def test_plans_drop_what_is_wrong(spark):
    fields = {"mood": "text", "steps": "number", "yoga": "boolean"}
    plan = lambda **d: resolver.resolve(d, fields, TODAY)
    p = plan(kind="filter", date_phrase="blue", filters=[{"field": "steps", "op": ">", "value": "many"}, {"field": "nope", "op": "==", "value": 1}])
    assert p.kind == "semantic" and len(p.notes) == 4
    assert plan(kind="filter", date_phrase="today").kind == "semantic"
    p = plan(kind="aggregate", aggregate={"metric": "mood", "stat": "mean", "group_by": "nope"})
    assert p.kind == "semantic" and not p.aggregate
    p = plan(kind="aggregate", aggregate={"metric": "steps", "stat": "best", "group_by": "yoga"}, filters=[{"field": "yoga", "op": "contains", "value": "done"}])
    assert p.aggregate == {"metric": "steps", "stat": "mean", "group_by": "yoga"} and p.filters == [{"field": "yoga", "op": "==", "value": True}]


def test_filters(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, 5.0, "Abc", True), (3, 7.0, "", False)], "id int, num double, txt string, flag boolean")
    ids = lambda *f: [r["id"] for r in df.where(filters.typed(*f)).orderBy("id").collect()]
    assert ids("num", "number", "!=", 5) == [3] and ids("num", "number", "contains", 5) == []
    assert ids("flag", "boolean", "!=", "on") == [1, 3] and ids("flag", "boolean", "contains", "done") == [2] and ids("flag", "boolean", "==", "y") == [3]
    assert ids("txt", "text", "==", "") == [1, 3] and ids("txt", "text", "contains", "B") == [2] and ids("txt", "text", "<", "b") == []
    with pytest.raises(ValueError):
        filters.typed("x", None, "==", 1)


def test_numbers(spark):
    df = spark.createDataFrame([("73.50 of 5.0 and +1,234 on 2024-01-02, 3/4, 6/7/2024; -3. v2 1.2.3 007 0.5",)], "t string")
    assert df.select(numbers_in(F.col("t"))).first()[0] == ["73.5", "5", "1234", "-3", "7", "0.5"]


def test_answers(spark):
    schema = "answer string, cited array<string>, claims array<struct<text:string,dates:array<string>>>, retrieved array<string>, question string, allowed array<string>, route string, unanswerable boolean"
    rows = [
        ("5 on 2024-01-02", ["a"], [("x", ["a"])], ["a", "b"], "", ["5"], "semantic", False),
        ("6", ["c"], [("x", []), ("y", ["b", "z"])], ["a", "b"], "", None, "semantic", False),
        ("6.0", [], [("x", [])], [], "is it 6?", [], "aggregate", False),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(answer.violations(*(F.col(c) for c in df.columns))).collect()]
    assert got[0] == [] and got[2] == []
    assert got[1] == ["cited date c was not among the retrieved days", "claim 1 names no date: 'x'", "claim 2 cites b, which is missing from cited_dates", "claim 2 cites z, which was not retrieved", "the number 6 in the answer does not appear in any cited day"]


def test_ask(spark):
    days = spark.createDataFrame([(f"2024-03-{i:02d}", 10.0 * i, f"walked {i} km near the river") for i in range(1, 13)], "date string, steps double, text string")
    fields = {"steps": "number"}
    calls = []

    def generate(question, evidence):
        calls.append(evidence)
        return {"answer": "It was 9999." if len(calls) == 1 else "It was 12.", "claims": [{"text": "x", "dates": ["2024-03-12"]}], "cited_dates": ["2024-03-12"]}

    got = answer.ask("which?", {"kind": "filter", "filters": [{"field": "steps", "op": ">", "value": 105}]}, days, fields, TODAY, generate)
    assert got["retrieved"] == ["2024-03-11", "2024-03-12"] and got["retries"] == 1 and not got["violations"]
    got = answer.ask("mean?", {"kind": "aggregate", "aggregate": {"metric": "steps", "stat": "mean"}}, days, fields, TODAY, lambda q, e: {"answer": "65", "cited_dates": []})
    assert "| all matching days | 12 | 65 |" in got["table"] and not got["violations"]
    assert answer.ask("?", {"kind": "unanswerable"}, days, fields, TODAY, generate)["answer"]["unanswerable"]
    got = answer.ask("river walk 7", {"kind": "semantic", "date_phrase": "from 3/6 to 3/8"}, days, fields, TODAY, lambda q, e: {"answer": "", "cited_dates": []})
    assert set(got["retrieved"]) == {"2024-03-06", "2024-03-07", "2024-03-08"}
    listed, n, capped = answer.list_days(days, "2024-03-02", "2024-03-04", ["steps"])
    assert (listed.count(), n, capped) == (3, 3, False)
