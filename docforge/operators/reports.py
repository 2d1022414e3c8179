"""Reports in one pass: chunk statistics by grouping sets, days in weeks, runs that resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_report(chunks: DataFrame, limits: tuple[int, ...] = (510, 254)) -> DataFrame:
    """A row for each chunker and document type, each chunker, and all: documents, chunks, median and largest size, chunks over each limit, and how first chunks begin.

    ``chunks`` (chunker, doc_id, doc_type, start, tokens, boundary).  One pass and
    one shuffle of partial sums serve all three levels; a median keeps a count for
    each size, and sizes are few.  Null chunker and type mark the wider levels.
    """
    first = F.row_number().over(Window.partitionBy("chunker", "doc_id").orderBy("start")) == 1
    rows = chunks.withColumn("opens", F.when(first, F.col("boundary")))
    sets = [["chunker", "doc_type"], ["chunker"], []]
    over = [F.count_if(F.col("tokens") > n).alias(f"over_{n}") for n in limits]
    level = F.grouping_id().alias("level")
    sums = rows.groupingSets(sets, "chunker", "doc_type").agg(level, F.count("opens").alias("docs"), F.count("*").alias("chunks"), F.median("tokens").alias("median_tokens"), F.max("tokens").cast("long").alias("max_tokens"), *over)
    kinds = rows.where("opens IS NOT NULL").groupBy("chunker", "doc_type", "opens").agg(F.count("*").alias("k")).groupingSets([[*s, "opens"] for s in sets], "chunker", "doc_type", "opens")
    # the third grouping column is in every set, so halving its number gives the level
    counts = kinds.agg(F.shiftright(F.grouping_id(), 1).alias("level"), F.sum("k").alias("k"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), F.col("opens").alias("b"))))
    said = counts.groupBy("level", F.col("chunker").alias("c"), F.col("doc_type").alias("t")).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["b"], F.lit(" "), (-x["o"]).cast("string"))), ", ").alias("boundaries")).withColumnRenamed("level", "at")
    same = (F.col("level") == F.col("at")) & F.col("chunker").eqNullSafe(F.col("c")) & F.col("doc_type").eqNullSafe(F.col("t"))
    return sums.join(said, same, "left").drop("at", "c", "t", "level")


def week_chunks(days: DataFrame, date: str = "date", text: str = "text") -> DataFrame:
    """(week, days, text): the days of each week from Monday on, at most seven, and their texts in order, a day a row."""
    week = F.date_trunc("week", F.col(date)).cast("date")
    kept = F.array_sort(F.collect_list(F.struct(F.col(date).cast("date").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    got = days.where(F.col(date).isNotNull()).groupBy(week.alias("week")).agg(kept.alias("k"))
    return got.select("week", F.transform("k", lambda x: x["d"]).alias("days"), F.array_join(F.transform("k", lambda x: x["t"]), "\n").alias("text"))


def coverage(expected: DataFrame, retrieved: DataFrame, ks: tuple[int, ...] = (3, 5, 10), by: str = "item_id") -> DataFrame:
    """Per query the share of its expected days that the first k chunks cover, and 1 / the first rank that covers one.

    ``expected`` (by, day), ``retrieved`` (by, rank, days); a chunk covers all of
    its days, and a day covered twice counts once.
    """
    own = expected.select(by, "day").distinct()
    seen = retrieved.select(by, "rank", F.explode("days").alias("day")).groupBy(by, "day").agg(F.min("rank").alias("rank"))
    met = own.join(seen, [by, "day"], "left")
    share: list[Column] = [F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 4).alias(f"recall_{k}") for k in ks]
    return met.groupBy(by).agg(*share, F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 4).alias("mrr"))


def resume(planned: DataFrame, progress: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arms, todo) of a run that stopped: what each arm has done, and what is left to do.

    ``planned`` (arm, item), ``progress`` (arm, item, score) as the progress file
    has it: lines may come twice (the last arm was begun again) or be of no plan.
    An arm is finished, partial or not reached; ``todo`` holds the items that a
    partial or unreached arm still has to run.
    """
    done = progress.groupBy("arm", "item").agg(F.max("score").alias("score"))
    met = planned.join(done.withColumn("ran", F.lit(True)), ["arm", "item"], "left")
    n, ran = F.count("*"), F.count("ran")
    status = F.when(ran == n, "finished").when(ran > 0, "partial").otherwise("not reached")
    arms = met.groupBy("arm").agg(n.alias("planned"), ran.alias("done"), status.alias("status"), F.round(F.avg("score"), 4).alias("mean_score"))
    return arms, planned.join(done, ["arm", "item"], "left_anti")


def first_of_each(rows: DataFrame, by: str, order: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each group; partial limits go before the shuffle, so no group is gathered whole."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_at") <= n)
