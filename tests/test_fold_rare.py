"""Folding walks over a text letter by letter only where it holds one of two rare letters."""

from pyspark.sql import functions as F

from docforge.functions import text as T


def test_only_texts_with_rare_letters_are_translated(spark):
    df = spark.createDataFrame([("Straße OAK",), ("DİYAR",), ("sır",), (None,)], "text string")
    made = df.select(T.fold(F.col("text")).alias("folded"), F.lower(F.upper(F.translate("text", "İı", "ii"))).alias("plain"))
    assert all(r["folded"] == r["plain"] for r in made.collect())
    assert "CASE WHEN" in df.select(T.fold(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
