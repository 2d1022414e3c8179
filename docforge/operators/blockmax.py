"""BM25 from kept postings in blocks that carry an upper bound of their scores.

Documents are cut into ranges of equal size; a block is one term's postings of one
range, a row.  It keeps the largest share of a score that the term gives any
document of the range, so the bounds of a query's terms add up to a bound of the
range.  A search reads the bounds of its terms alone, scores each query's most
promising ranges, and takes the k-th of those scores as a threshold: only ranges
whose bound reaches it are read and scored.  The result is that of a full scan.

A block holds at most a range of documents, whatever the term's frequency, so a
hot term is many rows and not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docforge.functions.text import bm25_tokens, parts
from docforge.operators.retrieve import K1, B, hint, top_k

#: Scores are ranked by ten digits; a bound that is less by no more than this still counts.
SLACK = 1e-9


def write_blocks(docs: DataFrame, path: str, key: str = "doc_id", span: int = 128, buckets: int = 64) -> None:
    """Keep an index of ``docs``: ``documents`` (range, dl, tokens and all columns but the text), ``blocks``, ``terms`` and, last, ``totals``.

    Ranges are runs of ``span`` documents within partitions of the key's order.
    Every text becomes tokens once; blocks are made from the kept tokens, dealt by
    range, the counts of terms from the blocks.
    """
    spark = docs.sparkSession
    toks = F.coalesce(bm25_tokens(F.col("text")), F.array().cast("array<string>"))
    ordered = docs.repartitionByRange(key).sortWithinPartitions(key)
    # a partition's rows are numbered in their order, from a multiple of 2^33
    placed = ordered.withColumn("range", F.floor(F.monotonically_increasing_id() / span).cast("long")).withColumn("tokens", toks)
    placed.withColumn("dl", F.size("tokens")).drop("text").write.parquet(f"{path}/documents")
    kept = spark.read.parquet(f"{path}/documents")
    totals = kept.agg(F.count("*").alias("ndocs"), F.avg("dl").alias("avgdl"))
    blocks = _made(kept.select(key, "range", "dl", "tokens").repartition(parts(docs), "range"), totals, key)
    at = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = blocks.select("*", at, F.pmod(F.xxhash64("range"), F.lit(4)).alias("_share")).repartition("bucket", "_share").sortWithinPartitions("bucket", "term", "range").drop("_share")
    dealt.write.partitionBy("bucket").parquet(f"{path}/blocks")
    counts = _blocks(spark, path, key).groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    raw = counts.crossJoin(F.broadcast(totals)).withColumn("raw", F.log(F.col("ndocs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf")
    raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean")))).select("bucket", "term", "df", idf).write.parquet(f"{path}/terms")
    totals.write.parquet(f"{path}/totals")


def _made(kept: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(range, term, most, n, postings) of documents dealt by range: their tokens are neither counted nor gathered elsewhere."""
    each = kept.select(key, "range", "dl", F.explode("tokens").alias("term"))
    tf = each.groupBy("range", key, "term").agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl")).crossJoin(F.broadcast(totals.select("avgdl")))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.groupBy("range", "term").agg(F.max(share).alias("most"), F.count("*").alias("n"), F.collect_list(F.struct(F.col(key).alias("key"), share.alias("share"))).alias("postings"))


def _blocks(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The blocks with their schema, which a corpus without tokens leaves in no file."""
    of = spark.read.parquet(f"{path}/documents").schema[key].dataType.simpleString()
    return spark.read.schema(f"range long, term string, most double, n long, postings array<struct<key:{of},share:double>>, bucket int").parquet(f"{path}/blocks")


def weights(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(item_id, term, bucket, w) of every query term that the corpus has; a repeated term counts again."""
    small = hint(queries, F.octet_length("text"))
    q = queries.select("item_id", F.explode_outer(bm25_tokens(F.col("text"))).alias("term")).where("term IS NOT NULL").groupBy("item_id", "term").agg(F.count("*").alias("qn"))
    return spark.read.parquet(f"{path}/terms").join(small(q), "term").select("item_id", "term", "bucket", (F.col("qn") * F.col("idf")).alias("w"))


def range_bounds(spark: SparkSession, path: str, weighted: DataFrame, small, key: str = "doc_id") -> DataFrame:
    """(item_id, range, bound, blocks): no document of the range scores above the bound.

    A term of negative weight adds nothing to a bound; a query that has one gets
    no bound (infinity), so all of its ranges are read.
    """
    got = _blocks(spark, path, key).select("bucket", "term", "range", "most").join(small(weighted), ["bucket", "term"])
    bound = F.when(F.min("w") < 0, F.lit(float("inf"))).otherwise(F.sum(F.col("w") * F.col("most")))
    return got.groupBy("item_id", "range").agg(bound.alias("bound"), F.count("*").alias("blocks"))


def _scores(spark: SparkSession, path: str, weighted: DataFrame, chosen: DataFrame, small, key: str, allowed: Column | None) -> DataFrame:
    """Exact scores of the allowed documents of the chosen (item_id, range).

    Ranges are as many as the corpus needs, so they are never broadcast: blocks of
    query terms are dealt by range, where each meets the queries that chose it.
    The same holds for allowed documents; the hints keep both from the driver where
    a shuffle turns out small when packed.
    """
    takers = chosen.groupBy("range").agg(F.collect_set("item_id").alias("takers")).hint("merge")
    blocks = _blocks(spark, path, key).join(small(weighted.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi").join(takers, "range")
    met = blocks.join(small(weighted), ["bucket", "term"]).where(F.array_contains("takers", F.col("item_id")))
    hits = met.select("item_id", "range", "w", F.explode("postings").alias("p"))
    sums = hits.groupBy("item_id", "range", F.col("p.key").alias(key)).agg(F.sum(F.col("w") * F.col("p.share")).alias("score"))
    if allowed is not None:
        sums = sums.join(spark.read.parquet(f"{path}/documents").where(allowed).select("range", key).hint("merge"), ["range", key], "left_semi")
    return sums.select("item_id", key, "score")


def chosen_ranges(spark: SparkSession, path: str, queries: DataFrame, k: int, allowed: Column | None = None, key: str = "doc_id", first: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bounds, the ranges of them that have to be read, weights) for each query's ``k`` best allowed documents."""
    small = hint(queries, F.octet_length("text") * 8)
    weighted = weights(spark, path, queries)
    bounds = range_bounds(spark, path, weighted, small, key)
    best = bounds.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "range"))).where(F.col("r") <= first)
    tried = top_k(_scores(spark, path, weighted, best, small, key, allowed), k, key=key)
    # fewer than k scored documents: no threshold, every range is read
    least = tried.groupBy("item_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("item_id", "least")
    need = bounds.join(least, "item_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).drop("least")
    return bounds, need, weighted


def kept_top_k(spark: SparkSession, path: str, queries: DataFrame, k: int, allowed: Column | None = None, key: str = "doc_id", first: int = 4) -> DataFrame:
    """What ``bm25_top_k`` gives, filter, zero scores and ranks included, from the index at ``path``."""
    small = hint(queries, F.octet_length("text") * 8)
    _, need, weighted = chosen_ranges(spark, path, queries, k, allowed, key, first)
    best = top_k(_scores(spark, path, weighted, need, small, key, allowed), k, key=key)
    own = spark.read.parquet(f"{path}/documents")
    own = own.select(key) if allowed is None else own.where(allowed).select(key)
    fill = queries.select("item_id").crossJoin(F.broadcast(own.orderBy(key).limit(2 * k))).withColumn("score", F.lit(0.0))
    every = best.select("item_id", key, "score").unionByName(fill).groupBy("item_id", key).agg(F.max_by("score", F.abs("score")).alias("score"))
    return top_k(every, k, key=key)
