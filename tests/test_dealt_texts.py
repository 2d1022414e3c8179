"""Partitions follow the bytes of texts, so that a task's share does not grow with the input."""

import pytest

from docforge.functions import text as T
from docforge.operators import chunking, retrieve


@pytest.fixture
def texts(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARE_BYTES", 100)
    return spark.createDataFrame([(i, "ALPHA beta\n1. Gamma delta\n" * 3) for i in range(30)] + [(31, None)], "doc_id long, text string")


def test_texts_are_dealt_by_bytes(spark, texts):
    assert T.parts(texts) == -(-30 * 78 // 100)
    assert T.parts(texts.where("doc_id > 30")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    typed = texts.selectExpr("doc_id", "text", "'contract' AS doc_type")
    items = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    for made in (retrieve.hash_buckets(texts), chunking.lines(typed), retrieve.bm25_scores(texts, items)):
        assert "RepartitionByExpression [doc_id" in made._jdf.queryExecution().optimizedPlan().toString()
        assert ", 24" in made._jdf.queryExecution().optimizedPlan().toString()
