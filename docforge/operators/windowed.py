"""Windows of several chunkers as counts of query terms, and their best by BM25.

A text becomes tokens once for all chunkers.  Words of a search are parts of
tokens and windows begin and end with tokens, so a window's words are a run of
its text's: neither windows' texts nor single words leave the task that holds
the text.  What is kept of a window are the query terms it holds; of all other
terms the number of windows that hold them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions.text import TOKEN, deal
from docforge.operators import batches, chunking, evaluate
from docforge.operators.retrieve import K1, B, bm25_scores, hint, query_matrix
from docforge.session import forget, shared_dir

#: Tokens of texts that a task cuts into windows at once.
TOKENS = 1 << 21
_WORDS = re.compile("[a-z0-9]+")
_INTS, _LONGS, _TERMS = (pa.list_(pa.field("element", t)) for t in (pa.int32(), pa.int64(), pa.string()))
_SCHEMA = pa.schema([("arm", pa.string()), ("chunk_id", pa.int64()), ("doc_id", pa.int64()), ("doc_type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("dl", pa.int32()), ("slots", _INTS), ("tfs", _INTS), ("terms", _TERMS), ("dfs", _LONGS)])
_COLUMNS = "arm string, chunk_id long, doc_id long, doc_type string, start long, end long, dl int, slots array<int>, tfs array<int>, terms array<string>, dfs array<long>"


def write_windows(docs: DataFrame, sizes: dict[str, tuple[int, int]], terms: pa.Array) -> DataFrame:
    """Rows of windows and rows of counts of ``docs`` (doc_id, doc_type, text) for each arm's (size, overlap), written once.

    A window's row (arm, chunk_id, doc_id, doc_type, start, end, dl, slots, tfs)
    says how often it holds which of ``terms``; a row of counts (arm, terms, dfs)
    says how many windows of some texts hold each of their terms.
    """
    tiles = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    own = deal(docs.where("doc_id IS NOT NULL").select("doc_id", "doc_type", "text"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "doc_type", tiles.alias("tiles"))
    path = shared_dir(docs.sparkSession)
    forget(docs.sparkSession, path)
    own.mapInArrow(_cut_task(sizes, terms), _COLUMNS).write.partitionBy("arm").parquet(path)
    return docs.sparkSession.read.schema(_COLUMNS).parquet(path)


def _cut_task(sizes: dict[str, tuple[int, int]], terms: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(passed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in passed:
            held = np.cumsum(pc.fill_null(pc.list_value_length(whole.column("tiles")), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < whole.num_rows:
                before = held[lo - 1] if lo else 0
                n = max(1, int(np.searchsorted(held, before + TOKENS, "right")) - lo)
                yield from _cut(whole.slice(lo, n), sizes, terms)
                lo += n

    return run


def _cut(part: pa.RecordBatch, sizes: dict[str, tuple[int, int]], terms: pa.Array) -> Iterator[pa.RecordBatch]:
    tiles = part.column("tiles")
    n = pc.fill_null(pc.list_value_length(tiles), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, coded = _sums(n), tiles.flatten().dictionary_encode()
    if not len(coded):
        return
    tile = coded.indices.to_numpy(zero_copy_only=False)
    length, own_length, held, spelt, said = _spelt(coded.dictionary.to_pylist())
    ends = np.cumsum(length[tile])
    begins, text = ends - own_length[tile], np.r_[0, ends][first]  # where each text begins in the run of all
    upto = _sums(held[tile])
    codes = said[np.repeat(_sums(held)[tile] - upto[:-1], held[tile]) + np.arange(upto[-1])]
    words, many = pa.array(spelt, pa.string()), max(1, len(spelt))
    slot_of = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False)
    ids, kinds = part.column("doc_id"), part.column("doc_type")
    for arm, (size, overlap) in sizes.items():
        step = size - overlap
        wins = np.where(n == 0, 0, np.where(n <= size, 1, 1 + -(-(n - size) // step)))
        doc = np.repeat(np.arange(len(n)), wins)
        win = np.arange(len(doc)) - _sums(wins)[doc]
        a = first[doc] + win * step
        b = np.minimum(a + size, first[doc + 1])
        dl = upto[b] - upto[a]
        at = np.repeat(upto[a] - _sums(dl)[:-1], dl) + np.arange(dl.sum())
        pairs, tf = np.unique(np.repeat(np.arange(len(doc)), dl) * many + codes[at], return_counts=True)
        own, code = pairs // many, pairs % many
        slot = slot_of[code] if len(code) else code
        asked = slot >= 0
        lists = pa.array(_sums(np.bincount(own[asked], minlength=len(doc))), pa.int32())
        doc_id = ids.take(pa.array(doc))
        rows = {
            "arm": pa.array([arm] * len(doc)), "chunk_id": pa.array(doc_id.to_numpy() * 100000 + win), "doc_id": doc_id, "doc_type": kinds.take(pa.array(doc)),
            "start": pa.array(begins[a] - text[doc]), "end": pa.array(ends[b - 1] - text[doc]), "dl": pa.array(dl, pa.int32()),
            "slots": pa.ListArray.from_arrays(lists, pa.array(slot[asked], pa.int32())), "tfs": pa.ListArray.from_arrays(lists, pa.array(tf[asked], pa.int32())),
        }
        yield _rows(rows, len(doc))
        found = np.bincount(code, minlength=len(words))
        yield _rows({"arm": pa.array([arm]), "terms": pa.array([words], _TERMS), "dfs": pa.array([found], _LONGS)}, 1)


def _spelt(tiles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(length, length without the gap before it, number of words) of each distinct tile, all words, and the words' numbers tile by tile."""
    bare, numbers, said, held = [t.lstrip() for t in tiles], {}, [], []
    for b in bare:
        own = _WORDS.findall(b.lower())
        held.append(len(own))
        said.extend(numbers.setdefault(w, len(numbers)) for w in own)
    count = lambda of: np.fromiter(map(len, of), np.int64, len(of))
    return count(tiles), count(bare), np.array(held, np.int64), list(numbers), np.array(said, np.int64)


def _rows(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _sums(counts: np.ndarray) -> np.ndarray:
    """Running sums from 0 on."""
    return np.r_[0, np.cumsum(counts)].astype(np.int64)


def arm_weights(windows: DataFrame, terms: pa.Array) -> dict[str, tuple[np.ndarray, float]]:
    """Of each arm the idf of ``terms`` (0 for those without a window) and the mean length; counts are summed where they lie."""
    spark = windows.sparkSession
    slots = spark.createDataFrame(pa.table({"term": terms, "slot": pa.array(range(len(terms)), pa.int32())}))
    totals = windows.where("chunk_id IS NOT NULL").groupBy("arm").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = windows.where("terms IS NOT NULL").select("arm", F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("arm", F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    raw = df.join(F.broadcast(totals), "arm").join(F.broadcast(slots), "term", "left").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    own = F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "raw"))).alias("own")
    out = {}
    for r in raw.groupBy("arm").agg(F.avg("raw").alias("mean"), F.first("avgdl").alias("avgdl"), own).collect():
        idf = np.zeros(len(terms))
        for slot, value in r["own"]:
            idf[slot] = 0.25 * r["mean"] if value < 0 else value
        out[r["arm"]] = idf, r["avgdl"]
    return out


def scoped_arms(docs: DataFrame, items: DataFrame, gold: DataFrame, sizes: dict[str, tuple[int, int]], ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """``evaluate.scope_table`` of the windows of each arm's (size, overlap) of ``docs`` (doc_id, doc_type, text).

    A query set within bounds goes to each task, which scores windows as they
    pass; pairs of a query and a window are gathered only beyond them.
    """
    if not (asked := query_matrix(items)):
        return _all_pairs(docs, items, gold, sizes, ks)
    matrix, ids, terms, kind = asked
    spark, k = docs.sparkSession, max(ks)
    windows = write_windows(docs, sizes, terms)
    chunks = windows.where("chunk_id IS NOT NULL")
    numbers = spark.createDataFrame(pa.table({"item_id": ids, "item": pa.array(range(len(ids)), pa.int32())}))
    own = gold.select("item_id", "doc_id").distinct().join(F.broadcast(numbers), "item_id").groupBy("doc_id").agg(F.collect_list("item").alias("items"))
    own = hint(own, F.size("items") * 4)(own)
    scores = spark.createDataFrame([], f"arm string, scope string, item_id {kind}, chunk_id long, score double")
    for arm, (idf, avgdl) in arm_weights(windows, terms).items():
        rows, task = chunks.where((F.col("arm") == arm) & (F.size("slots") > 0)), _best_task(matrix, ids, k, idf, avgdl)
        for scope, of in (("corpus", rows.select("chunk_id", "dl", "slots", "tfs")), ("scoped", rows.join(own, "doc_id").select("chunk_id", "dl", "slots", "tfs", "items"))):
            made = of.mapInArrow(task, f"item_id {kind}, chunk_id long, score double")
            scores = scores.unionByName(made.select(F.lit(arm).alias("arm"), F.lit(scope).alias("scope"), "*"))
    order = Window.partitionBy("arm", "scope", "item_id").orderBy(F.round("score", 10).desc(), "chunk_id")
    hits = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return evaluate.scope_means(hits.join(chunks.select("arm", "chunk_id", "doc_id", "doc_type", "start", "end"), ["arm", "chunk_id"]), gold, ks, tuple(sizes))


def _all_pairs(docs: DataFrame, items: DataFrame, gold: DataFrame, sizes: dict[str, tuple[int, int]], ks: tuple[int, ...]) -> DataFrame:
    spark, scores, made = docs.sparkSession, None, None
    for arm, (size, overlap) in sizes.items():
        wins = chunking.fixed_windows(docs, size, overlap).join(docs, "doc_id")
        chunks = wins.select((F.col("doc_id") * 100000 + F.col("win")).alias("chunk_id"), "doc_id", "doc_type", "start", "end", F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))").alias("text"))
        # written once: corpus counts, postings and ranges all read them
        path = shared_dir(spark)
        forget(spark, path)
        chunks.write.parquet(path)
        chunks = spark.read.parquet(path)
        # a chunk's number holds its document's, so pairs need no join to be ranked
        pairs = bm25_scores(chunks, items, key="chunk_id").select(F.lit(arm).alias("arm"), "item_id", "chunk_id", F.expr("chunk_id div 100000").alias("doc_id"), "score")
        own = chunks.select(F.lit(arm).alias("arm"), "chunk_id", "doc_type", "start", "end")
        scores, made = (pairs, own) if scores is None else (scores.unionByName(pairs), made.unionByName(own))
    return evaluate.scope_table(scores, gold, ks, made)


def _best_task(matrix: np.ndarray, ids: pa.Array, k: int, idf: np.ndarray, avgdl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: (item_id, chunk_id, score) of the windows that may be among each query's k best; with column ``items`` a window meets these queries alone."""
    asked = [(np.nonzero(q)[0], q[q > 0]) for q in matrix]

    def run(passed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = batches.Best(len(matrix), k), max(1, batches.CELLS // max(matrix.shape))
        held = np.zeros((matrix.shape[1], step))
        for whole in passed:
            for lo in range(0, whole.num_rows, step):
                part = whole.slice(lo, step)
                keys, n, (doc, slot) = part.column("chunk_id"), part.num_rows, _flat(part.column("slots"))
                tf, dl = part.column("tfs").flatten().to_numpy(), part.column("dl").to_numpy()
                value = idf[slot] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
                held[slot, doc] = value
                scores = np.array([w @ held[own, :n] for own, w in asked])
                if (value > 0).all():  # a common term is a score above zero
                    none = scores <= 0
                else:
                    holds = np.zeros((matrix.shape[1], n), bool)
                    holds[slot, doc] = True
                    none = np.array([~holds[own].any(0) for own, _ in asked])
                if "items" in part.schema.names:
                    others = np.ones((len(matrix), n), bool)
                    at, item = _flat(part.column("items"))
                    others[item, at] = False
                    none |= others
                scores[none] = -np.inf
                q, row = best.take(scores, keys, 1e-9)
                # summed again in one order, so equal windows score alike
                exact = np.zeros(len(q))
                for i in np.unique(q):
                    (own, w), of = asked[i], q == i
                    exact[of] = (w[:, None] * held[np.ix_(own, row[of])]).sum(0)
                held[slot, doc] = 0
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), keys.take(pa.array(row)), pa.array(exact)], ["item_id", "chunk_id", "score"])

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of its row, value) of all values."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
