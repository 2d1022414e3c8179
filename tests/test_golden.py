"""Question sets, evaluation, progress files and the response cache on written cases."""

import json

import pytest
from pyspark.sql import functions as F

from docforge.operators import evaluate, golden
from docforge.sources import progress, web


def question(i, kind="unanswerable", **more):
    return {"id": f"q{i}", "kind": kind, "question": "what?", "scope": {}, "gold_passages": [], "gold_rows": [], "expected_contract_ids": [], "expected_facts": [], "expected_verdict": None, "notes": ""} | more


def whole_set():
    passage = lambda doc: {"doc_id": doc, "start": 4, "end": 12, "category": "Cap"}
    out = [question(i, "clause", gold_passages=[passage("c1")], expected_facts=["CAP  is"]) for i in range(10)]
    out += [question(10 + i, "filing", gold_passages=[passage("rf_1")]) for i in range(6)]
    out += [question(16 + i, "filter", expected_contract_ids=["c1"]) for i in range(7)]
    out += [question(23 + i, "aggregate", expected_facts=["5"], gold_rows=["rev_1"] if i < 3 else []) for i in range(7)]
    out += [question(30 + i, "playbook_check", expected_verdict="matches", gold_passages=[passage("playbook"), passage("rf_1")]) for i in range(5)]
    return out + [question(35 + i) for i in range(5)]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([("c1", "contract", "The cap is ten dollars"), ("rf_1", "risk_factors", "many risks are here"), ("playbook", "playbook", "## 1. Cap and more")], "doc_id string, doc_type string, text string")
    spans = spark.createDataFrame([("c1", "Cap", 0, 10)], "doc_id string, category string, start int, end int")
    revenue = spark.createDataFrame([("rev_1",)], "row_id string")

    def run(lines):
        raw = spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines, 1)], "line long, value string")
        return sorted(r[0] for r in golden.problems(raw, docs, spans, revenue).collect())

    return run


def test_a_sound_set_has_no_problems(found):
    assert found(whole_set()) == []


def test_each_rule_is_told(found):
    q = whole_set()
    q[0] |= {"gold_passages": [{"doc_id": "c1", "start": 12, "end": 20, "category": "Cap"}], "expected_facts": []}
    q[1] |= {"expected_facts": ["euro"]}
    q[2] |= {"gold_passages": [{"doc_id": "c9", "start": 1, "end": 2}], "expected_facts": []}
    q[3] |= {"gold_passages": [{"doc_id": "c1", "start": 5, "end": 99, "category": "Cap"}], "expected_facts": []}
    q[4] |= {"gold_passages": [], "expected_facts": [], "question": " "}
    q[10] |= {"gold_passages": [{"doc_id": "c1", "start": 0, "end": 3}]}
    q[16] |= {"expected_contract_ids": []}
    q[23] |= {"expected_facts": [], "gold_rows": ["rev_9"]}
    q[30] |= {"expected_verdict": "maybe"}
    q[35] |= {"gold_rows": ["rev_1"], "expected_verdict": "matches"}
    q[36] |= {"kind": "odd"}
    del q[37]["scope"]
    q[38] |= {"id": "q39"}
    got = found([*q, "", "not json", "[1]"])
    for part in ("line 1 (q0): gold_passages[0]: [12, 20) overlaps no labelled span of Cap", "line 2 (q1): expected fact 'euro'", "line 3 (q2): gold_passages[0]: c9 is not a selected", "line 4 (q3): gold_passages[0]: offsets [5, 99) are outside 0..22", "line 5 (q4): a clause question needs", "line 5 (q4): empty question", "line 11 (q10): gold_passages[0]: a filing passage", "line 17 (q16): a filter question", "line 24 (q23): an aggregate question", "line 24 (q23): revenue row rev_9 does not exist", "line 31 (q30): expected_verdict must be", "line 36 (q35): an unanswerable", "line 36 (q35): only playbook_check", "line 37 (q36): unknown kind 'odd'", "line 38 (q37): missing field scope", "id 'q39' appears 2 times", "line 42: not JSON", "line 43: not an object", "mix: 4 unanswerable questions, expected 5"):
        assert any(p.startswith(part) for p in got), (part, got)


def test_scopes_and_arms(spark):
    recs = spark.createDataFrame([("c1", [(0, "Cap", 10), (20, "Cap", 30), (5, "Parties", 9)]), ("c2", [(0, "Term", 5)])], "contract_id string, spans array<struct<start:int,category:string,end:int>>")
    words = spark.createDataFrame([("Cap", "what cap?"), ("Term", "what term?")], "category string, question string")
    queries, gold = evaluate.build_queries(recs, words, ("Parties",))
    assert sorted(r["item_id"] for r in queries.collect()) == ["c1/Cap", "c2/Term"] and gold.count() == 3
    hits = spark.createDataFrame([("c1/Cap", "rf", "risk_factors", 0, 99, 1), ("c1/Cap", "c1", "contract", 0, 5, 2), ("c1/Cap", "c1", "contract", 25, 26, 4)], "item_id string, doc_id string, doc_type string, start int, end int, rank int")
    rows = evaluate.evaluate(hits, queries, gold, "corpus").unionByName(evaluate.evaluate(hits, queries, gold, "scoped"))
    got = {(r["item_id"], r["scope"]): (r["recall_3"], r["recall_5"], r["mrr"], r["wrong"]) for r in rows.collect()}
    assert got[("c1/Cap", "corpus")] == (0.5, 1.0, 0.5, 1) and got[("c1/Cap", "scoped")][3] == 0 and got[("c2/Term", "corpus")] == (0.0, 0.0, 0.0, 0)
    assert {r["scope"]: r["recall_5"] for r in evaluate.summarise_scopes(rows).collect()} == {"corpus": 0.5, "scoped": 0.5}
    done = spark.createDataFrame([("hash", "fixed", "dense", 0.5)], "embedding string, chunker string, mode string, recall_5 double")
    grid = {(r["embedding"], r["chunker"], r["mode"]): r["status"] for r in evaluate.ablation(done, missing={"minilm": "no model file", "cross-encoder": "no model"}).collect()}
    assert len(grid) == 24 and grid[("hash", "fixed", "dense")] == "done" and grid[("minilm", "fixed", "dense")] == "not run: no model file" and grid[("hash", "fixed", "hybrid+cross-encoder")] == "not run: no model" and grid[("hash", "fixed", "hybrid")] == "not run: not reached"


def test_scores(spark):
    df = spark.createDataFrame([(["a", "b"], [["a"], ["x", "b"]], ["Ten", "six"], "ten of them")], "e array<string>, r array<array<string>>, f array<string>, t string")
    assert tuple(df.select(evaluate.covered(F.col("e"), F.col("r"), 1), evaluate.covered(F.col("e"), F.col("r"), 2), evaluate.facts_present(F.col("f"), F.col("t"))).first()) == (0.5, 1.0, 0.5)
    rows = [("semantic", True, 0.5, 1.0, None, None, True, False, False, False, 1, 10), ("filter", False, 1.0, 0.5, True, 0.5, None, None, False, False, None, 20), ("unanswerable", True, None, None, None, None, None, True, True, True, 0, 30)]
    rec = spark.createDataFrame(rows, "kind string, route_ok boolean, recall_5 double, mrr double, exact boolean, facts double, citations_valid boolean, abstained boolean, should_abstain boolean, hard_fail boolean, retries int, latency_ms int")
    got = evaluate.aggregate_scores(rec).first()
    assert (got["n"], got["route_accuracy"], got["recall_all"], got["filter_exact"], got["abstained_rightly"], got["should_abstain"], got["should_answer"], got["hard_fails"], got["retries"]) == (3, 0.6667, 0.75, 1.0, 1, 1, 1, 1, 1)


def test_progress_survives(spark, tmp_path):
    r = progress.Recorder(tmp_path, "run", {"k": 5})
    r.append({"type": "row", "a": 1})
    with open(r.path, "a") as f:
        f.write('{"type": "row", "a"')
    meta, rows = progress.read_progress(spark, str(r.path), "a int")
    assert meta.count() == 1 and [x["a"] for x in rows.collect()] == [1]
    r.partial("half", {"n": 1})
    assert r.path.exists() and json.loads((tmp_path / "run-partial.json").read_text())["partial"]
    r = progress.Recorder(tmp_path, "run", {})
    r.finish("whole", {})
    assert not r.path.exists() and (tmp_path / "run.md").read_text() == "whole"
    with pytest.raises(KeyboardInterrupt), progress.interruptible():
        __import__("os").kill(__import__("os").getpid(), 15)


def test_responses(tmp_path):
    calls, slept, answers = [], [], [(200, b'{"a": 1}', {}), (404, b"", {}), (429, b"", {"Retry-After": "7"}), (200, b"ok", {})]

    def transport(url, headers):
        calls.append((url, headers["User-Agent"]))
        return answers.pop(0)

    c = web.Client(tmp_path, "A Person a@example.com", transport, rate=10, sleep=slept.append)
    assert c.json("u:x") == c.json("u:x") == {"a": 1} and c.get("u:none") is None and c.get("u:none") is None
    assert c.get("u:late") == b"ok" and 7.0 in slept and c.stats == {"cache_hits": 2, "requests": 4, "errors": 1}
    assert web.Client(tmp_path).get("u:late") == b"ok"
    with pytest.raises(LookupError):
        web.Client(tmp_path).get("u:never")
    answers[:] = [(503, b"", {})] * 5 + [(403, b"", {})]
    with pytest.raises(web.Unavailable):
        c.get("u:down")
    assert not c._place("u:down").exists()
    with pytest.raises(web.Blocked):
        c.get("u:blocked")
    with pytest.raises(ValueError):
        web.Client(tmp_path, "a@example.com", transport, rate=11)
    with pytest.raises(ValueError):
        web.Client(tmp_path, "nobody", transport)
    (tmp_path / "f").write_bytes(b"x")
    with pytest.raises(ValueError):
        web.checked_file(tmp_path / "f", "0")
    assert not (tmp_path / "f").exists()
