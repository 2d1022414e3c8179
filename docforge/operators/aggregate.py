"""The aggregate route: one statistic, optionally by group or by match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = ("mean", "median", "count", "min", "max")


def statistic(stat: str, metric: str | None) -> Column:
    """Nulls are left out; a count without a metric counts rows."""
    if stat not in STATS:
        raise ValueError(f"unknown statistic {stat!r}")
    if metric is None:
        if stat != "count":
            raise ValueError(f"{stat} needs a metric")
        return F.count("*").cast("double")
    made = {"mean": F.avg, "median": F.median, "count": F.count, "min": F.min, "max": F.max}[stat](metric)
    return made.cast("double")


#: Rank error of the sketch that brackets a median is at most 1 / ACCURACY of a group.
ACCURACY = 20_000


def exact_median(df: DataFrame, metric: str, by: Column) -> DataFrame:
    """(name, median) of each group without a group ever meeting in one task.

    A mergeable sketch gives two values of the group with both middle ranks well
    between them.  One pass counts what lies below; of the values in between,
    about 1 / 2500 of a group, equal ones are counted together, and only those
    counts are sorted.  A NaN sorts last, which the sketch takes as infinity.
    """
    rows = df.select(by.alias("_name"), F.col(metric).cast("double").alias("_v")).where("_v IS NOT NULL")
    low, high = 0.5 - 4 / ACCURACY, 0.5 + 4 / ACCURACY
    edge = rows.groupBy("_name").agg(F.percentile_approx(F.when(F.isnan("_v"), float("inf")).otherwise(F.col("_v")), [low, high], ACCURACY).alias("_p"), F.count("*").alias("_n"))
    edge = edge.select(F.col("_name").alias("_k"), F.col("_p")[0].alias("_lo"), F.col("_p")[1].alias("_hi"), "_n")
    near = rows.join(edge, F.col("_name").eqNullSafe(F.col("_k")))
    place = F.when(F.col("_v") < F.col("_lo"), F.lit(None).cast("double")).otherwise(F.col("_v"))
    counts = near.where("_v <= _hi OR _hi = double('infinity')").groupBy("_name", place.alias("_v")).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy("_name").orderBy(F.col("_v").asc_nulls_first()))
    ranked = counts.withColumn("_e", upto)
    # a value stands at ranks e - c + 1 to e; the middle ranks are floor((n + 1) / 2) and floor(n / 2) + 1
    holds = lambda r: (F.col("_e") >= r) & (F.col("_e") - F.col("_c") < r)
    first, second = F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")
    middle = ranked.groupBy("_name").agg(F.max(F.when(holds(first), F.col("_v"))).alias("a"), F.max(F.when(holds(second), F.col("_v"))).alias("b"))
    missed = F.raise_error(F.lit("the sketch does not bracket the median")).cast("double")
    return middle.select(F.col("_name").alias("name"), F.coalesce((F.col("a") + F.col("b")) / 2, missed).alias("median"))


def aggregate(df: DataFrame, stat: str, metric: str | None = None, group_by: str | None = None, match: Column | None = None) -> DataFrame:
    """(name, n, value): a row a group, both sides of a match, or one row."""
    value = statistic(stat, metric)
    whole = match is None and group_by is None
    if match is not None:
        name = F.when(match, "match").otherwise("all other days")
    else:
        name = F.lit("all matching days") if whole else F.col(group_by)
    # the median is joined below; a group without values has none
    made = [F.count("*").alias("n"), (F.lit(None).cast("double") if stat == "median" else value).alias("value")]
    got = df.agg(name.alias("name"), *made) if whole else df.groupBy(name.alias("name")).agg(*made)
    if stat == "median":
        middle = exact_median(df, metric, name).withColumnRenamed("name", "_of")
        got = got.join(middle, F.col("name").eqNullSafe(F.col("_of")), "left").select("name", "n", F.col("median").alias("value"))
    if match is None:
        return got
    sides = df.sparkSession.createDataFrame([("match",), ("all other days",)], "name string")
    return sides.join(got, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0.0)).alias("value") if stat == "count" else F.col("value"))
