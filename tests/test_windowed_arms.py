"""Windows are scored as they pass: neither pairs of a query and a window nor windows' texts are gathered."""

import random
import sys

import pytest

from docforge.functions.text import SPACE
from docforge.operators import evaluate, retrieve, windowed
from docforge.plans import reports

WORDS = ["oak", "Elm", "ash_fir", "fir", "don't", "naïve", "Kelvin", "İst", "12.5", "東京", " ", "\x1c\x1c", " ", "𝒳y", *(f"w{j}" for j in range(25))]


def table(df):
    return sorted(tuple(r[c] for c in ("arm", "scope", "n", "recall_3", "recall_5", "recall_10", "mrr", "wrong_types")) for r in df.collect())


@pytest.mark.parametrize("few", [False, True])
def test_as_all_pairs(spark, few):
    rng = random.Random(5 + few)
    words = ["oak", "elm"] if few else WORDS  # of few words each is in most windows, and no weight is above zero
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, rng.choice(["contract", "playbook"])) for i, t in enumerate([*texts, *texts[:5], None, "", " ", "!", "東京"])], "doc_id long, text string, doc_type string")
    asked = [" ".join(t.split()[2:5]) for t in texts[:12] if len(t.split()) > 5] + ["oak oak", "zzz", "", None, "東京"]
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    gold = evaluate.gold_spans(docs, items).cache()
    sizes = {"a": (7, 2), "b": (3, 1)}
    assert table(windowed.scoped_arms(docs, items, gold, sizes)) == table(windowed._all_pairs(docs, items, gold, sizes, (3, 5, 10)))


def test_pairs_are_not_gathered(spark, monkeypatch, tmp_path):
    def gathered(*_, **__):
        raise AssertionError("pairs are gathered")

    for module in (retrieve, windowed):
        monkeypatch.setattr(module, "bm25_scores", gathered)
    spark.createDataFrame([(1, "an oak and an elm", "en"), (2, "oak, oak", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "oak and"), (2, "oak,")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # a word of both texts weighs less than nothing, so the one with two of it comes last
    assert table(reports.scoped_arms(spark, str(tmp_path))) == [(arm, scope, 2, 1.0, 1.0, 1.0, mrr, wrong) for arm in ("fixed", "narrow") for scope, mrr, wrong in (("corpus", 0.75, 2), ("scoped", 1.0, 1))]


def test_gaps_are_the_same_in_both_languages(spark):
    points = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    held = spark.createDataFrame([(c,) for c in points if c.isspace()] + [(c,) for c in points[:0x3100] if not c.isspace()], "c string")
    got = {r["c"] for r in held.where(held["c"].rlike(rf"^{SPACE}\z")).collect()}
    assert got == {c for c in points if c.isspace()}
