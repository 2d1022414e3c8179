"""Set-oriented retrieval: BM25, hashed and dense vectors, fusion, rerank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docforge.functions.text import bm25_tokens, deal, hash_token, parts
from docforge.operators import batches

#: Fixed values of ranking.
K1, B, RRF_K, CANDIDATES = 1.5, 0.75, 60, 20


#: A query set of at most so many bytes is broadcast; a larger one is shuffled by the join's key.
BROADCAST_BYTES = 16 << 20
#: Rows of corpus totals beside the terms; no token is spelt like these.
_DOCS, _LENGTH = "#docs", "#length"


def hint(queries: DataFrame, size: Column) -> Callable[[DataFrame], DataFrame]:
    """How what is made of ``queries`` joins: by broadcast where all of ``size`` (bytes a row) was summed and is within bounds."""
    total = queries.agg(F.sum(F.coalesce(size, F.lit(0)) + 16)).first()[0] or 0
    return F.broadcast if total <= BROADCAST_BYTES else lambda d: d


def _text_hint(queries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return hint(queries, F.octet_length("text"))


def bm25_stats(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Terms (term, df, idf) and totals (ndocs, avgdl) of the whole corpus, a document a row.

    Each text gives its distinct terms and two rows of totals, so one pass and one
    shuffle of partial counts serve both; the filters wait for the sums lest they
    be pushed down and make two passes of one.
    """
    toks = docs.select(F.coalesce(bm25_tokens(F.col(text)), F.array().cast("array<string>")).alias("toks"))
    each = toks.select(F.size("toks").alias("dl"), F.explode_outer(F.concat(F.array_distinct("toks"), F.array(F.lit(_DOCS), F.lit(_LENGTH)))).alias("term"))
    n = F.when(F.col("term") == _LENGTH, F.col("dl")).otherwise(1).cast("long")
    counts = each.where("term IS NOT NULL").groupBy("term").agg(F.sum(n).alias("df"))
    of = lambda name: F.max(F.when(F.col("term") == name, F.col("df")))
    totals = counts.agg(F.coalesce(of(_DOCS), F.lit(0)).alias("ndocs"), (of(_LENGTH) / of(_DOCS)).alias("avgdl"))
    odds = F.log(F.col("ndocs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = counts.crossJoin(F.broadcast(totals)).withColumn("raw", F.when(~F.col("term").isin(_DOCS, _LENGTH), odds))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.where("raw IS NOT NULL").crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return terms, totals


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, term): every token of every text with the length of its text."""
    toks = docs.select(key, bm25_tokens(F.col(text)).alias("toks"))
    # the outer form: the plain one has the optimizer test the tokens' number first, and so makes them three times
    return toks.select(key, F.size("toks").alias("dl"), F.explode_outer("toks").alias("term")).where("term IS NOT NULL")


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id", allowed: Column | None = None) -> DataFrame:
    """(item_id, key, score) of every ``allowed`` document that shares a term; a repeated query term counts again.

    Tokens that no query has go where texts are dealt, by document, which serves
    both the counts of terms and the sums.
    """
    small = _text_hint(queries)
    terms, totals = bm25_stats(docs)
    q = _query_terms(queries)
    own = _dealt_postings(docs, allowed, key).join(small(q.select("term").distinct()), "term", "left_semi")
    tf = own.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    weighted = terms.join(small(q), "term").select("item_id", "term", (F.col("qn") * F.col("idf")).alias("w"))
    return _summed(tf.join(small(weighted), "term").crossJoin(F.broadcast(totals.select("avgdl"))), key)


def _dealt_postings(docs: DataFrame, allowed: Column | None, key: str) -> DataFrame:
    """Postings of the ``allowed`` texts, dealt before they are cut: a task that reads would hold all tokens of its split for the shuffle."""
    own = docs if allowed is None else docs.where(allowed)
    return postings(deal(own.select(key, "text"), key, n=parts(docs)), key)


def _query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("item_id", F.explode_outer(bm25_tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("qn"))


def _share(weight: str) -> Column:
    """What a term of a document adds to a score."""
    return F.col(weight) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _summed(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy("item_id", key).agg(F.sum(_share("w")).alias("score"))


def _bm25_best(docs: DataFrame, queries: DataFrame, k: int, allowed: Column | None, key: str) -> DataFrame:
    """The k best by ``bm25_scores``; a bounded query set goes to each task, which scores documents as they pass."""
    if held := _query_table(queries):
        table, words = held
        if asked := sparse_task(table, queries.schema["item_id"].dataType.simpleString(), len(words), k, key):
            slots = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"term": words, "slot": pa.array(range(len(words)), pa.int32())})))
            terms, totals = bm25_stats(docs)
            own = _dealt_postings(docs, allowed, key).join(slots, "term").select(key, "slot", "dl")
            tf = own.groupBy(key, "slot").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
            shares = tf.join(F.broadcast(terms.join(slots, "term").select("slot", "idf")), "slot").crossJoin(F.broadcast(totals.select("avgdl")))
            return top_k(_passed(shares.select(key, "slot", _share("idf").alias("value")), asked, key), k, key=key)
    return top_k(bm25_scores(docs, queries, key, allowed), k, key=key)


def top_k(scores: DataFrame, k: int, by: str = "item_id", key: str = "doc_id") -> DataFrame:
    """Rank by rounded score, then id; rank is 1-based."""
    order = Window.partitionBy(by).orderBy(F.round("score", 10).desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, allowed: Column | None = None, key: str = "doc_id") -> DataFrame:
    """Corpus statistics from all documents; only ``allowed`` ones rank, and zero scores fill up to k."""
    best = _bm25_best(docs, queries, k, allowed, key)
    own = docs.where(allowed).select(key) if allowed is not None else docs.select(key)
    # whoever has k scored rows needs no fill; others have them all in ``best``, and 2k least ids fill any gap
    fill = queries.select("item_id").crossJoin(F.broadcast(own.orderBy(key).limit(2 * k))).withColumn("score", F.lit(0.0))
    every = best.select("item_id", key, "score").unionByName(fill).groupBy("item_id", key).agg(F.max_by("score", F.abs("score")).alias("score"))
    return top_k(every, k, key=key)


def hash_buckets(docs: DataFrame, dims: int = 1024, key: str = "doc_id") -> DataFrame:
    """(key, bucket, cnt): sparse hashed bag of words; each distinct token is hashed once.

    Texts are dealt by key first, so neither the counts nor the sums move again.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[,:]", " "), r"\s+"), lambda w: w != "")
    tok = deal(docs.select(key, "text"), key).select(key, F.explode_outer(words).alias("tok")).where("tok IS NOT NULL").groupBy(key, "tok").agg(F.count("*").alias("n"))
    return tok.withColumn("bucket", F.pmod(hash_token(F.col("tok")), F.lit(dims))).groupBy(key, "bucket").agg(F.sum("n").alias("cnt"))


def _unit_buckets(docs: DataFrame, key: str) -> DataFrame:
    """(key, bucket, w): sparse hashed vectors of length one."""
    norm = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(Window.partitionBy(key)))
    return hash_buckets(docs, key=key).select(key, "bucket", (F.col("cnt") / norm).alias("w"))


def hash_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cosine of sparse hashed vectors, summed where the document's buckets are."""
    qv = _unit_buckets(queries, "item_id").select("item_id", "bucket", F.col("w").alias("qw"))
    return _unit_buckets(docs, key).join(_text_hint(queries)(qv), "bucket").groupBy("item_id", key).agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def hash_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", dims: int = 1024) -> DataFrame:
    """The k best by ``hash_scores``; a bounded query set goes to each task, which scores vectors as they pass."""
    if _text_hint(queries) is F.broadcast and (asked := sparse_task(_unit_buckets(queries, "item_id").select("item_id", F.col("bucket").alias("slot"), "w").toArrow(), queries.schema["item_id"].dataType.simpleString(), dims, k, key)):
        return top_k(_passed(_unit_buckets(docs, key).select(key, F.col("bucket").cast("int").alias("slot"), F.col("w").alias("value")), asked, key), k, key=key)
    return top_k(hash_scores(docs, queries, key), k, key=key)


def sparse_matrix(weights: pa.Table, dims: int) -> tuple[np.ndarray, pa.Array] | None:
    """(matrix of items by slots, items) of ``weights`` (item_id, slot, w) of a bounded query set; None without queries, or if items by slots are more than a block."""
    item = weights.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    ids = item.dictionary
    if not len(ids) or len(ids) * dims > batches.CELLS:
        return None
    matrix = np.zeros((len(ids), dims))
    matrix[item.indices.to_numpy(), weights.column("slot").to_numpy()] = weights.column("w").to_numpy()
    return matrix, ids


def sparse_task(weights: pa.Table, kind: str, dims: int, k: int, key: str):
    """(function of ``mapInArrow``, type of item_id) for a ``sparse_matrix``; None where there is none."""
    made = sparse_matrix(weights, dims)
    return made and (batches.product_task(*made, k, key), kind)


def _query_table(queries: DataFrame) -> tuple[pa.Table, pa.Array] | None:
    """((item_id, slot, w), terms by slot) of a query set within bounds: how often a query holds which term; None beyond them."""
    if _text_hint(queries) is not F.broadcast:
        return None
    held = _query_terms(queries).where("term IS NOT NULL").toArrow()
    term = held.column("term").combine_chunks().dictionary_encode()
    return pa.table({"item_id": held.column("item_id"), "slot": term.indices, "w": held.column("qn").cast(pa.float64())}), term.dictionary


def query_matrix(queries: DataFrame) -> tuple[np.ndarray, pa.Array, pa.Array, str] | None:
    """(matrix of items by terms, items, terms, type of item_id) of a query set within bounds; None beyond them."""
    if not (held := _query_table(queries)) or not (made := sparse_matrix(held[0], len(held[1]))):
        return None
    return *made, held[1], queries.schema["item_id"].dataType.simpleString()


def _passed(rows: DataFrame, asked: tuple, key: str) -> DataFrame:
    """What ``asked`` lets out of ``rows`` (key, slot, value), which lie by key in their partitions."""
    return rows.sortWithinPartitions(key).mapInArrow(asked[0], f"item_id {asked[1]}, {key} {rows.schema[key].dataType.simpleString()}, score double")


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)"


#: Pairs of a query and a row that a task scores.
PAIRS = 100_000_000


def dealt_pairs(rows: DataFrame, queries: int, key: str) -> DataFrame:
    """``rows`` dealt by key into tasks of about ``PAIRS`` pairs with so many queries, one at least a core."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * queries // PAIRS))
    return rows.repartition(n, key)


def near_task(queries: DataFrame, k: int, key: str, cells: DataFrame | None = None, column: str = "embedding"):
    """(function of ``mapInArrow``, number of queries, type of item_id, number of cells) for a bounded query set; None if its vectors are not all whole and of one length.

    ``cells`` (item_id, cells) are the cells that each query reads, None for all.
    """
    own = queries.select("item_id", "qvec")
    kind = own.schema["item_id"].dataType.simpleString()
    if cells is not None:
        own = own.join(cells, "item_id")
    held = own.toArrow().combine_chunks()
    vectors = [v.as_py() for v in held.column("qvec")]
    if not vectors or any(v is None or None in v or len(v) != len(vectors[0]) for v in vectors):
        return None
    marks = None
    if cells is not None:
        read = held.column("cells").to_pylist()
        marks = np.zeros((len(read), 1 + max((c for r in read for c in r), default=0)), bool)
        for i, r in enumerate(read):
            marks[i, r] = True
    ids = pa.concat_arrays(held.column("item_id").chunks)
    return batches.cosine_task(np.array(vectors, np.float64), ids, k, key, column, marks), len(vectors), kind, 0 if marks is None else marks.shape[1]


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """Exact cosine of every query vector with every vector; ties by id.

    ``queries`` (item_id, qvec) goes to each task within bounds, which scores its
    batches by matrix products and lets out what may be among the best (``batches``).
    Beyond them it is cut into blocks of about ``block`` vectors; a vector meets
    each block under a salt, so no task holds more than one block and one share of
    the vectors.
    """
    if hint(queries, F.size("qvec") * 8) is F.broadcast and (asked := near_task(queries, k, "vec_id")):
        return top_k(dealt_pairs(vectors.select("vec_id", "embedding"), asked[1], "vec_id").mapInArrow(asked[0], f"item_id {asked[2]}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"), k, key="vec_id")
    v = vectors.withColumn("norm", F.expr(f"sqrt({_dot('embedding', 'embedding')})"))
    q = queries.withColumn("qnorm", F.expr(f"sqrt({_dot('qvec', 'qvec')})"))
    blocks, salts = max(1, -(-queries.count() // block)), 16
    v = v.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = v.join(q, ["_block", "_salt"])
    pairs = pairs.withColumn("score", F.expr(f"{_dot('qvec', 'embedding')} / (qnorm * norm)"))
    return top_k(pairs.select("item_id", "vec_id", "score"), k, key="vec_id")


def write_postings(docs: DataFrame, path: str, key: str = "doc_id", buckets: int = 256) -> None:
    """Keep the postings of a corpus as tables, which later searches read by their terms alone.

    ``terms`` and ``totals`` stand beside ``postings``, which lie in folders by a
    term's bucket, sorted by term.  Documents spread each bucket over several
    files, so a hot term does not make one task; ``totals`` comes last and marks a
    whole index.  A path that is there already raises: a new index takes a new path.
    """
    terms, totals = bm25_stats(docs)
    at = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    tf = postings(docs, key).repartition(key).groupBy(key, "term").agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl"))
    dealt = tf.select("*", at, F.pmod(F.xxhash64(key), F.lit(4)).alias("_share")).repartition("bucket", "_share").sortWithinPartitions("bucket", "term").drop("_share")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    terms.select("*", at).write.parquet(f"{path}/terms")
    totals.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/totals")


def kept_scores(spark: SparkSession, path: str, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """What ``bm25_scores`` gives, from an index that ``write_postings`` kept: only buckets of query terms are read."""
    small = _text_hint(queries)
    q = _query_terms(queries)
    weighted = spark.read.parquet(f"{path}/terms").join(small(q), "term").select("item_id", "term", "bucket", (F.col("qn") * F.col("idf")).alias("w"))
    hits = spark.read.parquet(f"{path}/postings").join(small(weighted), ["bucket", "term"])
    return _summed(hits.crossJoin(F.broadcast(spark.read.parquet(f"{path}/totals").select("avgdl"))), key)


def rrf(lists: list[DataFrame], key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (item_id, key, rank)."""
    rows = lists[0].select("item_id", key, "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("item_id", key, "rank"))
    fused = rows.groupBy("item_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), key)))


def lexical_rerank(hits: DataFrame, docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", candidates: int = CANDIDATES) -> DataFrame:
    """Rerank by rare shared words: df counts within the candidate set of the query.

    ``hits`` holds at most ``candidates`` a query, so within bounds it goes to
    where the texts are and no text moves but those of candidates.
    """
    small = hint(queries, F.lit(32 * candidates))
    cand = docs.select(key, "text").join(small(hits.select("item_id", key, F.col("rank").alias("dense_rank"))), key)
    dset = cand.select("item_id", key, F.explode(F.array_distinct(bm25_tokens(F.col("text")))).alias("term"))
    qset = queries.select("item_id", F.array_distinct(bm25_tokens(F.col("text"))).alias("q")).select("item_id", F.size("q").alias("qn"), F.explode("q").alias("term"))
    both = dset.join(qset, ["item_id", "term"])
    df = both.groupBy("item_id", "term").agg(F.count("*").alias("df"))
    score = both.join(df, ["item_id", "term"]).groupBy("item_id", key).agg(F.sum(1.0 / (1 + F.col("df")) / F.col("qn")).alias("s"))
    out = cand.select("item_id", key, "dense_rank").join(score, ["item_id", key], "left").withColumn("rerank_score", F.round(F.coalesce("s", F.lit(0.0)), 4)).drop("s")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("rerank_score"), "dense_rank"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 5, mode: str = "hybrid", rerank: bool = False, candidates: int = CANDIDATES, key: str = "doc_id") -> DataFrame:
    """First stage, fusion and rerank as one plan; an unknown mode raises."""
    if mode not in ("dense", "bm25", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    n = max(candidates, k) if rerank or mode == "hybrid" else k
    ranked = [bm25_top_k(docs, queries, n, key=key)] if mode != "dense" else []
    if mode != "bm25":
        ranked.append(hash_top_k(docs, queries, n, key))
    hits = rrf(ranked, key).where(F.col("rank") <= n) if len(ranked) > 1 else ranked[0]
    return lexical_rerank(hits, docs, queries, k, key, n) if rerank else hits.where(F.col("rank") <= k)
