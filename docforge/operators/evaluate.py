"""Recall and reciprocal rank by overlap of code-point ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions.text import SPACE, fold, phrase_pattern, phrase_steps, phrase_words
from docforge.operators.retrieve import hint
from docforge.session import forget, shared_dir


def covers(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open ranges that share a place."""
    return (a_start < b_end) & (b_start < a_end)


def gold_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, start, end) of every place of an item's words in their order, in any case and with any white space between them; a document a row.

    The inner words of a phrase are whole words of every text that holds it.  The
    longest of them, folded, is the key on which phrases meet the distinct folded
    words of texts; the phrase's pattern then decides.  A phrase without inner
    words has no such key: such phrases are tested against each text.  A match may
    be longer or shorter than its phrase, so its offsets in the text as it stands
    are running sums of the lengths of gaps and matches, over rows without texts.
    """
    word = F.array_max(F.transform(F.expr("slice(words, 2, greatest(size(words) - 2, 0))"), lambda w: F.struct(F.char_length(w).alias("n"), fold(w).alias("w"))))["w"]
    it = items.select("item_id", phrase_pattern(F.col("text")).alias("pattern"), phrase_words(F.col("text")).alias("words")).where("pattern IS NOT NULL").select("item_id", "pattern", word.alias("word"))
    small = hint(items, F.octet_length("text"))
    keyed, short = it.where("word IS NOT NULL"), it.where("word IS NULL").drop("word")
    words = docs.select("doc_id", "text", F.explode_outer(F.array_distinct(F.split(fold(F.col("text")), f"{SPACE}+"))).alias("word")).where("word IS NOT NULL")
    if small is F.broadcast:
        near = words.join(small(keyed), "word")
    else:  # words without their texts move; texts join the pairs that are left
        near = words.drop("text").join(keyed, "word").join(docs.select("doc_id", "text"), "doc_id")
    columns = ["item_id", "doc_id", "text", "pattern"]
    hit = near.select(columns).unionByName(docs.select("doc_id", "text").join(small(short), F.expr("regexp_like(text, pattern)")).select(columns))
    steps = hit.select("item_id", "doc_id", F.posexplode(phrase_steps(F.col("text"), F.col("pattern"))).alias("at", "step")).select("item_id", "doc_id", "at", "step.*")
    end = F.sum(F.col("gap") + F.col("own")).over(Window.partitionBy("item_id", "doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("item_id", "doc_id", (end - F.col("own")).alias("start"), end.alias("end"))


def places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same places with the texts."""
    return gold_spans(docs, items).join(docs.select("doc_id", "text"), "doc_id").select("item_id", "doc_id", "text", "start", "end")


def score(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Per query: share of gold spans that a top-k hit of the same document overlaps, and 1 / first such rank."""
    g = gold.select("item_id", "doc_id", F.col("start").alias("gs"), F.col("end").alias("ge"))
    best = g.join(hits.select("item_id", "doc_id", "start", "end", "rank"), ["item_id", "doc_id"], "left").groupBy("item_id", "doc_id", "gs", "ge").agg(F.min(F.when(covers(F.col("start"), F.col("end"), F.col("gs"), F.col("ge")), F.col("rank"))).alias("r"))
    share = [F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in ks]
    return best.groupBy("item_id").agg(*share, F.round(F.coalesce(1.0 / F.min("r"), F.lit(0.0)), 4).alias("mrr"))


def summarise(rows: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Means of already rounded rows, rounded again."""
    return rows.agg(F.count("*").alias("n"), *(F.round(F.avg(f"recall_{k}"), 4).alias(f"recall_{k}") for k in ks), F.round(F.avg("mrr"), 4).alias("mrr"))


def build_queries(records: DataFrame, questions: DataFrame, metadata: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(queries, gold): one query a contract and clause category, asked in the category's words.

    ``records`` (contract_id, spans of start, category, end), ``questions``
    (category, question); ``metadata`` categories are left out.
    """
    spans = records.select("contract_id", F.explode("spans").alias("s")).select("contract_id", "s.*").where(~F.col("category").isin(*metadata))
    item = F.concat_ws("/", "contract_id", "category").alias("item_id")
    queries = spans.groupBy("contract_id", "category").agg(F.count("*").alias("n_gold")).join(questions, "category")
    return queries.select(item, "contract_id", "category", F.col("question").alias("text"), "n_gold"), spans.select(item, F.col("contract_id").alias("doc_id"), "start", "end")


def evaluate(hits: DataFrame, queries: DataFrame, gold: DataFrame, scope: str, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """One row a query and ``scope``: recall, reciprocal rank, and hits of other document types among the first five.

    ``hits`` (item_id, doc_id, doc_type, start, end, rank); scoped ones hold only
    the query's own document.
    """
    own = hits.join(queries.select("item_id", "contract_id"), "item_id")
    if scope == "scoped":
        own = own.where("doc_id = contract_id")
    wrong = own.where("rank <= 5").groupBy("item_id").agg(F.count_if(F.col("doc_type") != "contract").alias("wrong"))
    scored = score(own.select("item_id", "doc_id", "start", "end", "rank"), gold, ks)
    return queries.select("item_id").join(scored, "item_id", "left").join(wrong, "item_id", "left").select("item_id", F.lit(scope).alias("scope"), *(F.coalesce(f"recall_{k}", F.lit(0.0)).alias(f"recall_{k}") for k in ks), F.coalesce("mrr", F.lit(0.0)).alias("mrr"), F.coalesce("wrong", F.lit(0)).alias("wrong"))


def summarise_scopes(rows: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Means of already rounded rows for each scope, and all hits of other types."""
    return rows.groupBy("scope").agg(F.count("*").alias("n"), *(F.round(F.avg(f"recall_{k}"), 4).alias(f"recall_{k}") for k in ks), F.round(F.avg("mrr"), 4).alias("mrr"), F.sum("wrong").alias("wrong_doc_type_in_top5"))


def scope_table(scores: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (3, 5, 10), chunks: DataFrame | None = None) -> DataFrame:
    """(arm, scope, n, recall, mrr, wrong types) of chunks scored once and ranked in every scope.

    ``scores`` (arm, item_id, chunk_id, doc_id, doc_type, start, end, score) come
    from one first stage an arm; scope ``corpus`` ranks all chunks, ``scoped``
    those of documents with a place of the query.  ``gold`` (item_id, doc_id,
    start, end); a place counts as found at the first rank whose chunk overlaps
    it.  Only the first chunks of each list leave the tasks that hold the scores;
    with ``chunks`` (arm, chunk_id, doc_type, start, end) they alone meet their
    chunks, and ``scores`` does without those columns.
    """
    own = gold.select("item_id", "doc_id").distinct().withColumn("own", F.lit(True))
    both = F.when(F.col("own"), F.array(F.lit("corpus"), F.lit("scoped"))).otherwise(F.array(F.lit("corpus")))
    marked = scores.join(own, ["item_id", "doc_id"], "left").withColumn("scope", F.explode(both))
    order = Window.partitionBy("arm", "scope", "item_id").orderBy(F.round("score", 10).desc(), "chunk_id")
    hits = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(ks))
    return scope_means(hits if chunks is None else hits.join(chunks, ["arm", "chunk_id"]), gold, ks)


def scope_means(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (3, 5, 10), names: tuple[str, ...] = ()) -> DataFrame:
    """``scope_table`` of the ranked ``hits`` (arm, scope, item_id, doc_id, doc_type, start, end, rank); arms ``names`` have rows even without hits."""
    # a few rows a query, read three times below: written once, so chunks are scored once
    spark = hits.sparkSession
    path = shared_dir(spark)
    forget(spark, path)
    hits.select("arm", "scope", "item_id", "doc_id", "doc_type", "start", "end", "rank").write.parquet(path)
    hits = spark.read.parquet(path)
    named = spark.createDataFrame([(n,) for n in names], "arm string") if names else hits.select("arm").distinct()
    arms = named.withColumn("scope", F.explode(F.array(F.lit("corpus"), F.lit("scoped"))))
    # arms and scopes are a handful
    g = gold.select("item_id", "doc_id", F.col("start").alias("gs"), F.col("end").alias("ge")).distinct().crossJoin(F.broadcast(arms))
    by = ["arm", "scope", "item_id"]
    found = F.min(F.when(covers(F.col("start"), F.col("end"), F.col("gs"), F.col("ge")), F.col("rank"))).alias("r")
    best = g.join(hits, [*by, "doc_id"], "left").groupBy(*by, "doc_id", "gs", "ge").agg(found)
    rows = best.groupBy(*by).agg(*(F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in ks), F.round(F.coalesce(1.0 / F.min("r"), F.lit(0.0)), 4).alias("mrr"))
    wrong = hits.where("rank <= 5").groupBy(*by).agg(F.count_if(F.col("doc_type") != "contract").alias("w"))
    means = [F.round(F.avg(f"recall_{k}"), 4).alias(f"recall_{k}") for k in ks]
    return rows.join(wrong, by, "left").groupBy("arm", "scope").agg(F.count("*").alias("n"), *means, F.round(F.avg("mrr"), 4).alias("mrr"), F.coalesce(F.sum("w"), F.lit(0)).alias("wrong_types"))


#: Embedding arms with the model each needs, and ways of retrieval.
ARMS = {"minilm": ("all-MiniLM-L6-v2", 256), "bge-small": ("BAAI/bge-small-en-v1.5", 512), "e5-small": ("intfloat/e5-small-v2", 512), "hash": ("hash-test", None)}
MODES = ("dense", "hybrid", "hybrid+cross-encoder")


def ablation(finished: DataFrame, chunkers: tuple[str, ...] = ("fixed", "section"), missing: dict[str, str] | None = None) -> DataFrame:
    """Every planned arm with its result or the reason it was not run: a grid without gaps.

    ``finished`` (embedding, chunker, mode, and figures); ``missing`` gives the
    reason of an arm or a mode that cannot be loaded.
    """
    grid = [(e, c, m) for e in ARMS for c in chunkers for m in MODES]
    why = missing or {}
    rows = [(e, c, m, why.get(e) or next((why[k] for k in why if k in m), None)) for e, c, m in grid]
    planned = finished.sparkSession.createDataFrame(rows, "embedding string, chunker string, mode string, reason string")
    got = planned.join(finished.withColumn("done", F.lit(True)), ["embedding", "chunker", "mode"], "left")
    state = F.when(F.col("done"), "done").when(F.col("reason").isNotNull(), F.concat(F.lit("not run: "), F.col("reason"))).otherwise("not run: not reached")
    return got.withColumn("status", state).drop("done", "reason")


def covered(expected: Column, retrieved: Column, k: int) -> Column:
    """Share of the expected days that the first ``k`` chunks cover; a chunk may cover several (array of arrays)."""
    seen = F.array_distinct(F.flatten(F.slice(retrieved, 1, k)))
    own = F.array_distinct(expected)
    return F.when(F.size(own) > 0, F.round(F.size(F.array_intersect(own, seen)) / F.size(own), 4))


def facts_present(facts: Column, text: Column) -> Column:
    """Share of the facts that the text holds, whatever their case; null without facts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(facts) > 0, F.round(F.size(F.filter(facts, lambda f: F.contains(low, F.lower(f)))) / F.size(facts), 4))


def aggregate_scores(records: DataFrame) -> DataFrame:
    """One row over the records of a run; what a record lacks does not count.

    ``records`` (kind, route_ok, recall_5, mrr, exact, facts, citations_valid,
    abstained, should_abstain, hard_fail, retries, latency_ms).
    """
    of = lambda kind, c: F.round(F.avg(F.when(F.col("kind") == kind, F.col(c))), 4)
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 4)
    pooled = F.round(F.avg(F.when(F.col("kind").isin("semantic", "filter"), F.col("recall_5"))), 4)
    should, said = F.col("should_abstain"), F.col("abstained")
    return records.agg(
        F.count("*").alias("n"), share("route_ok").alias("route_accuracy"), of("semantic", "recall_5").alias("recall_semantic"), of("filter", "recall_5").alias("recall_filter"),
        pooled.alias("recall_all"), of("semantic", "mrr").alias("mrr_semantic"), F.round(F.avg(F.when(F.col("kind") == "filter", F.col("exact").cast("int"))), 4).alias("filter_exact"),
        F.round(F.avg("facts"), 4).alias("facts"), share("citations_valid").alias("citations_valid"),
        F.count_if(should & said).alias("abstained_rightly"), F.count_if(should & said.isNotNull()).alias("should_abstain"),
        F.count_if(~should & said).alias("abstained_wrongly"), F.count_if(~should & said.isNotNull()).alias("should_answer"),
        F.count_if("hard_fail").alias("hard_fails"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms"),
    )
