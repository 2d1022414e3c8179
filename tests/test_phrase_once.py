"""A phrase is made plain once, and a rule takes its groups once."""

import datetime as dt

from pyspark.sql import functions as F

from docforge.plans import phrases


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_phrase_is_made_plain_once(spark):
    df = spark.createDataFrame([("On the week of 6/14?",), ("between 1/5 and 2024-01-02",), ("from 1/5 to 2/30",)], "p string")
    got = df.select("p", phrases.phrase_range(F.col("p"), F.lit(dt.date(2024, 3, 1))).alias("r"))
    assert plan(got).count("[?.!]+$") == 1
    day = dt.date
    assert [r["r"] and tuple(r["r"]) for r in got.collect()] == [(day(2024, 6, 14), day(2024, 6, 20)), (day(2024, 1, 2), day(2024, 1, 5)), None]
