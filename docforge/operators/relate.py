"""Joins and picks of the enrichment steps: names, filings, priorities, samples."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def unique_keys(names: DataFrame) -> DataFrame:
    """(key, n, cik, name) of an index (key, cik, name): one row a key, the least spelling."""
    return names.groupBy("key").agg(F.count_distinct("cik").alias("n"), F.min("cik").alias("cik"), F.min_by("name", F.struct("cik", "name")).alias("name"))


def exact_match(left: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose key names exactly one id."""
    return left.join(unique_keys(names).where("n = 1").select("key", "cik", F.col("name").alias("matched")), "key")


def ambiguous_match(left: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each id of a key that names several."""
    many = unique_keys(names).where("n > 1").select("key")
    return left.join(names.join(many, "key", "left_semi").select("key", "cik").distinct(), "key")


@F.pandas_udf(StructType([StructField("close", DoubleType()), StructField("score", DoubleType())]))
def _ratios(key: pd.Series, other: pd.Series) -> pd.DataFrame:
    """Likeness with the key second, which decides and ranks, and with it first, which is reported."""
    pairs = [(difflib.SequenceMatcher(None, b, a).ratio(), difflib.SequenceMatcher(None, a, b).ratio()) for a, b in zip(key, other, strict=True)]
    return pd.DataFrame(pairs, columns=["close", "score"], dtype=float)


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def letter_counts(key: Column) -> Column:
    """How often each letter and digit stands in a key, and all else together."""
    own = [F.char_length(key) - F.char_length(F.replace(key, F.lit(c), F.lit(""))) for c in _LETTERS]
    rest = F.char_length(F.regexp_replace(key, "[a-z0-9]", ""))
    return F.array(*own, rest)


def fuzzy_pairs(left: DataFrame, keys: DataFrame, least: float, prefix: int = 3) -> DataFrame:
    """(key, other, ...) that may be as alike as ``least``: one prefix, fitting lengths, and enough letters in common.

    Likeness is at most 2 x (letters in common) / (sum of lengths), and letters in
    common are no more than the shorter length.  A key is put once at every length
    that the second bound lets through, so the join's key is prefix and length: a
    frequent prefix is split by length and no pair of unfit lengths is made.  The
    first bound is then taken from letter counts, without a Python worker.
    """
    n = F.char_length("key")
    low, high = F.ceil(n * least / (2 - least) - 1e-9).cast("int"), F.floor(n * (2 - least) / least + 1e-9).cast("int")
    asked = left.where(n >= 5).select("*", F.substring("key", 1, prefix).alias("pre"), letter_counts(F.col("key")).alias("letters"), F.explode(F.sequence(low, high)).alias("size"))
    listed = keys.select("*", F.substring("other", 1, prefix).alias("pre"), letter_counts(F.col("other")).alias("others"), F.char_length("other").alias("size"))
    pairs = asked.join(listed, ["pre", "size"])
    common = F.aggregate(F.zip_with("letters", "others", lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
    return pairs.withColumn("bound", 2 * common / (n + F.col("size"))).where(F.col("bound") >= least - 1e-9).drop("letters", "others", "pre", "size")


def fuzzy_match(left: DataFrame, names: DataFrame, least: float = 0.85, prefix: int = 3, top: int = 3) -> DataFrame:
    """Similar keys that share a prefix: the best ``top`` of each, and of those the ones with one id; ties go to the later key."""
    keys = names.groupBy(F.col("key").alias("other")).agg(F.min("cik").alias("cik"), F.count_distinct("cik").alias("n"))
    judged = fuzzy_pairs(left, keys, least, prefix).withColumn("r", _ratios("key", "other")).where(F.col("r.close") >= least)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("r.close"), F.desc("other")))
    best = judged.withColumn("at", rank).where((F.col("at") <= top) & (F.col("n") == 1))
    return best.withColumn("score", F.round("r.score", 4)).drop("at", "n", "r", "bound")


def nearest_days(asked: DataFrame, listed: DataFrame, by: str) -> DataFrame:
    """(by, day, at, one, k) of every asked (by, day): the nearest listed day that has a ``one``, the later of two as near, and the sum of all ``k`` of the group.

    ``listed`` (by, day, one, k) has a row a day.  Both sides are a row a day and
    group, so no pair of rows is made: running picks from before and from after
    decide.
    """
    rows = asked.select(by, "day", F.lit(True).alias("asked")).distinct().join(listed, [by, "day"], "full_outer")
    own = F.when(F.col("one").isNotNull(), F.struct(F.col("day").alias("at"), "one"))
    past = F.last(own, True).over(Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    later = F.last(own, True).over(Window.partitionBy(by).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("k", F.sum("k").over(Window.partitionBy(by))).withColumn("past", past).withColumn("later", later).where("asked")
    nearer = F.col("past").isNull() | (F.datediff("later.at", "day") <= F.datediff("day", "past.at"))
    pick = F.when(F.col("later").isNotNull() & nearer, F.col("later")).otherwise(F.col("past"))
    return both.select(by, "day", F.coalesce("k", F.lit(0)).alias("k"), pick.alias("p")).select(by, "day", "p.at", "p.one", "k")


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, other_at: str, keep: list[str]) -> DataFrame:
    """As-of in both directions: the least gap, the later on ties, then the least ``keep``."""
    gap = F.datediff(F.col(other_at), F.col(at))
    pick = F.min(F.struct(F.abs(gap).alias("g"), (-F.unix_date(F.col(other_at))).alias("d"), *keep, gap.alias("gap_days"))).alias("p")
    return left.join(right, by).groupBy(*left.columns).agg(pick).select(*left.columns, *(F.col(f"p.{k}") for k in keep), "p.gap_days")


def same_day_status(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, status, n): filings of one day, narrowed by form unless that leaves none."""
    j = left.join(right, ["cik", "day"], "left")
    by_form = F.count_if(F.col("other_form") == F.col("form"))
    n = F.when(by_form > 0, by_form).otherwise(F.count("other_form"))
    out = j.groupBy("id").agg(n.alias("n"), F.max("day").alias("day"))
    status = F.when(F.col("day").isNull(), "no_date").when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return out.select("id", status.alias("status"), F.col("n").cast("long").alias("n"))


def priority_pick(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def capped_selection(df: DataFrame, key: str, kind: str, tier: str, cap: int, target: int) -> DataFrame:
    """Tier by tier in hash order, at most ``cap`` of a kind and ``target`` in all."""
    order = [F.col(tier), F.md5(F.col(key).cast("string"))]
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_k") <= cap)
    return ranked.orderBy(*order).limit(target).drop("_k")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, change) of two indexes (doc_id, hash): new, changed, unchanged or removed."""
    j = old.select("doc_id", F.col("hash").alias("was")).join(new.select("doc_id", F.col("hash").alias("now")), "doc_id", "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return j.select("doc_id", change.alias("change"))
