"""Playbooks are told from headings in a text's own row."""

from docforge.functions import records


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_playbook_headings_are_not_shuffled(spark):
    whole = "### Preferred position\nours\n### Acceptable fallback\ntheirs\n### Escalate if\n"
    texts = {
        "twice": f"intro\n## 1. **Price**:\n{whole}ever\n## Term\n{whole} \n## Price\n### Escalate if\n\n## Filing-data\n### Escalate if\nnever\n",
        "high": "## Price\n## Preferred position\nours\n### Other\n\n### Preferred position\n",
        "early": "### Escalate if\nnow\n## Escalate if\nnow\n",
        "none": None,
    }
    got = records.playbook_status(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))
    assert not any(node in plan(got) for node in ("Join", "Window", "Aggregate", "Generate"))
    rows = {r["doc_id"]: (r["categories"], r["filled"], r["empty"], r["problems"]) for r in got.collect()}
    short = lambda n: f"{n} category headings, expected 10"
    # the last heading of a name counts, under whichever heading of the category; an optional section is none
    assert rows["twice"] == (2, 4, ["Price / Escalate if", "Term / Escalate if"], [short(2)])
    high = ["Price / Preferred position", "Price / Acceptable fallback", "Price / Escalate if"]
    assert rows["high"] == (1, 0, high, [short(1), "'## Preferred position' under Price should be '### Preferred position'"])
    assert rows["early"] == rows["none"] == (0, 0, [], [short(0)])
