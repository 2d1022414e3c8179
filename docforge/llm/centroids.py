"""Centroid clustering by plain Lloyd rounds.

The centroids (``k`` rows of 64 integers) go to the tasks with each pass;
mapInPandas computes the integer squared differences to every centroid, argmin
takes the lowest number, and a task's counts and sums leave it as one row a
centroid, which groupBy merges.  Vectors are read once into compact integers in
the shared folder, so each round is one pass over them without a shuffle of rows.

Defined results: vectors that are null, of another length, or hold null or
non-finite components are left out; rows without a vec_id are clustered but start
no centroid; repeated rows count as often as they stand (of starts with one id the
lesser stored bytes come first); with fewer than ``k`` kept vectors there
are as many centroids; an empty table gives an empty one; further columns are
ignored; a squared distance or a sum beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import cut, drop_cut
from docforge.llm.lattice import SUMS, Sums, as_long, integers, merged, moved, narrow, on_lattice, squared

SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equals the smallest number."""
    far = squared(x, centroids)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best]


def starts(rows: DataFrame, k: int, size: int, scale: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the least sha256 of ``1:<vec_id>``, in that order."""
    first = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit("1:"), "vec_id"), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return narrow(integers([bytes(r["x"]) for r in first], size, scale))


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = vectors.sparkSession
    rows = cut(on_lattice(vectors.where(F.size("embedding") == size), scale).select("vec_id", "x"))
    book = starts(rows, k, size, scale)
    if not len(book):
        return spark.createDataFrame([], SCHEMA)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Sums(len(book), size)
        for pdf in batches:
            if len(pdf):
                x = integers(pdf["x"].to_list(), size, scale)
                own.add(x, nearest(x, book)[0])
        yield pd.DataFrame(own.rows(0), columns=["part", "entry", "digit", "n", "s"])

    for _ in range(rounds):
        sums = merged(rows.select("x").mapInPandas(totals, SUMS), size)
        book = moved(book, {e: v for (_, e), v in sums.items()})

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                best, far = nearest(integers(pdf["x"].to_list(), size, scale), book)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "cluster": best.astype(np.int32), "distance": pd.array(as_long(far), "Int64")})

    placed = cut(rows.mapInPandas(assign, "vec_id string, cluster int, distance long"))
    drop_cut(rows)
    # at most k rows: exact sums in decimals, nulls (beyond a long) make theirs null
    per = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("t"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    sums = {r["cluster"]: None if r["lost"] else int(r["t"]) for r in per}
    whole = None if None in sums.values() else sum(sums.values())
    fit = lambda v: v if v is not None and v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book.tolist()]
    about = spark.createDataFrame([(c, fit(v), fit(whole), digest[c]) for c, v in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.withColumn("vec_id", F.col("vec_id").cast("long")).join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
