"""Phrases in any case and spacing against Python's own matching, and the spellings of durations."""

import random
import re

import pytest

from docforge.functions import extract
from docforge.operators import evaluate


def brute(docs, items):
    out = []
    for i, phrase in items:
        words = (phrase or "").split()
        if words:
            pattern = re.compile(r"\s+".join(map(re.escape, words)), re.I)
            out += [(i, d, *m.span()) for d, t in docs for m in pattern.finditer(t or "")]
    return sorted(out)


DOCS = [
    (1, "Quick  brown\nFox and the QUICK\t\x0b brown fox; quickbrown fox"),
    (2, None),
    (3, ""),
    (4, "a.b (c) \\E \\Q x+y  A.B\n(C)"),
    (5, "Éte é  ÉTÉ été  ete  É"),
    (6, "aaa aaaa AA aa" * 3),
    (7, "one two three one two three ONE TWO\nTHREE"),
    (8, "im İstanbul ıstanbul ISTANBUL istanbul x"),
]
ITEMS = [(1, "quick brown fox"), (2, " the  quick "), (3, "A.B (c)"), (4, "\\E \\Q x+y"), (5, "été é"), (6, "aa"), (7, "two three one two"), (8, ""), (9, None), (10, " \n"), (11, "x"), (12, "aa aaaa aa"), (13, "im istanbul")]


@pytest.mark.parametrize("bound", [None, 0])
def test_places_as_python_finds_them(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr("docforge.operators.retrieve.BROADCAST_BYTES", bound)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = evaluate.gold_spans(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(DOCS, ITEMS)


def test_random_phrases(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB") for _ in range(rng.randint(1, 3)))
    docs = [(i, rng.choice([" ", "\n", ""]).join(word() + rng.choice(["", " ", "  \t"]) for _ in range(60))) for i in range(40)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(40)]
    got = evaluate.places(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    text = dict(docs)
    rows = [(r["item_id"], r["doc_id"], r["start"], r["end"]) for r in got.collect()]
    assert sorted(rows) == brute(docs, items)
    assert all(r["text"] == text[r["doc_id"]] for r in got.collect())


SPELLINGS = {
    "ninety(90) days": ["90 days"], "90days": ["90 days"], "thirty ( 30 ) days": ["30 days"], "90 - day": ["90 days"], "90-day notice, 90 days": ["90 days"], "one hundred twenty  (120)\nbusiness\tdays": ["120 days"],
    "ninety (90) calendar days and one year": ["90 days", "1 year"], "twenty-one days": ["21 days"], "x5 days": [], "5 (five) days": [], "0 weeks": ["0 weeks"], "": [], "ONE  MONTH": ["1 month"],
}


def test_spellings_of_durations(spark):
    rows = spark.createDataFrame(list(SPELLINGS.items()), "text string, want array<string>")
    for r in rows.select("text", "want", extract.durations_in(rows["text"]).alias("got")).collect():
        assert r["got"] == r["want"], r["text"]
