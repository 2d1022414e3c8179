"""Inverted-file search of vectors: cells, probes by cell, exact cosines.

Cells are learnt on a bounded sample; every vector is then kept with its nearest
cell, and each cell with the widest angle of its members.  A search either probes
each query's nearest cells (approximate, as fast as the probes are few) or reads,
after those, all cells that could still hold one of the k best: a member is no
nearer to the query than the cell's centre less the cell's angle.  Cosines are
computed from whole vectors in double precision either way.

Vectors that are null, zero, of another length or hold no finite number are in no
cell.  Ties go to the lower id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docforge.operators.retrieve import dealt_pairs, hint, near_task, top_k

#: Vectors that cells are learnt from, by least hash of their ids; a documented bound, all are assigned.
SAMPLE = 20_000
#: Angles are widened by so much against rounding.
SLACK = 1e-6


def _units(values: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of usable vectors, those vectors at length one)."""
    at, rows = [], []
    for i, v in enumerate(values):
        if v is not None and len(v) == size:
            x = np.array([np.nan if y is None else y for y in v], np.float64)
            top = np.abs(x).max() if size else 0.0
            if np.isfinite(top) and top > 0:
                x = x / top
                at.append(i)
                rows.append(x / np.sqrt(x @ x))
    return np.array(at, np.int64), np.array(rows).reshape(len(rows), size)


def learn_cells(vectors: DataFrame, cells: int, rounds: int = 8, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Unit centres [cell, dim] from at most ``sample`` vectors; of several lengths the most frequent among them counts."""
    rows = vectors.where(F.col(column).isNotNull()).select(F.xxhash64(F.col(key)).alias("h"), key, column).orderBy("h", key).limit(sample).select(column).collect()
    if not rows:
        return np.zeros((0, 0))
    size = int(np.bincount([len(r[0]) for r in rows]).argmax())
    x = _units(pd.Series([r[0] for r in rows]), size)[1]
    centre = x[:: max(1, len(x) // max(1, cells))][:cells].copy()
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            total = x[near == c].sum(0)
            if np.abs(total).max(initial=0) > 0:
                centre[c] = total / np.sqrt(total @ total)
    return centre


def write_cells(vectors: DataFrame, path: str, cells: int = 64, key: str = "vec_id", column: str = "embedding") -> None:
    """Keep ``vectors`` by cell, sorted by angle within, with ``centres`` (cell, centre, widest angle, members)."""
    spark, centre = vectors.sparkSession, learn_cells(vectors, cells, key=key, column=column)

    @F.pandas_udf("cell int, angle double")
    def nearest(values: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": pd.array([None] * len(values), "Int32"), "angle": np.nan})
        at, x = _units(values, centre.shape[1])
        if len(at):
            cos = x @ centre.T
            near = cos.argmax(1)
            out.loc[at, "cell"], out.loc[at, "angle"] = near.astype(np.int32), np.arccos(np.clip(cos[np.arange(len(at)), near], -1, 1))
        return out

    placed = vectors.withColumn("_at", nearest(column)).select("*", "_at.cell", "_at.angle").drop("_at").where("cell IS NOT NULL")
    # a full cell lies in several files: its vectors are dealt by key as well
    dealt = placed.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(8))).repartition("cell", "_share").sortWithinPartitions("cell", "angle").drop("_share")
    dealt.write.partitionBy("cell").parquet(f"{path}/vectors")
    made = spark.createDataFrame([(c, v) for c, v in enumerate(centre.tolist())], "cell int, centre array<double>")
    wide = spark.read.schema(placed.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("widest"), F.count("*").alias("members"))
    made.join(wide, "cell").write.parquet(f"{path}/centres")


_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)"


def _dot(a: str, b: str):
    return F.expr(_DOT.format(a=a, b=b))


def _gaps(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(item_id, cell, least angle between query and members, rank of the cell's centre); queries meet the bounded centres."""
    centres = spark.read.parquet(f"{path}/centres")
    pairs = queries.select("item_id", "qvec", F.sqrt(_dot("qvec", "qvec")).alias("qnorm")).where("qnorm > 0 AND qnorm < double('infinity')").crossJoin(F.broadcast(centres))
    cos = _dot("qvec", "centre") / (F.col("qnorm") * F.sqrt(_dot("centre", "centre")))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    near = F.row_number().over(Window.partitionBy("item_id").orderBy("apart", "cell"))
    return pairs.withColumn("apart", apart).select("item_id", "cell", F.greatest(F.lit(0.0), F.col("apart") - F.col("widest") - SLACK).alias("gap"), near.alias("near"))


def _hits(spark: SparkSession, path: str, queries: DataFrame, chosen: DataFrame, k: int, key: str, column: str) -> DataFrame:
    """(item_id, key, score): at least each query's ``k`` best of its chosen cells."""
    if hint(queries, F.size("qvec") * 8) is F.broadcast:
        own = chosen.groupBy("item_id").agg(F.collect_set("cell").alias("cells"))
        asked = near_task(queries.where("item_id IS NOT NULL"), k, key, own, column)
        if asked:
            every, kept = asked[3], spark.read.parquet(f"{path}/vectors").select(key, column, "cell")
            return dealt_pairs(kept, asked[1], key).where(F.col("cell") < every).mapInArrow(asked[0], f"item_id {asked[2]}, {key} {kept.schema[key].dataType.simpleString()}, score double")
    q = queries.join(chosen.select("item_id", "cell"), "item_id").select("item_id", "cell", "qvec", F.sqrt(_dot("qvec", "qvec")).alias("qnorm"))
    small = hint(queries, F.size("qvec") * 8 * 64)
    pairs = spark.read.parquet(f"{path}/vectors").withColumn("norm", F.sqrt(_dot(column, column))).join(small(q), "cell")
    return pairs.select("item_id", key, (_dot("qvec", column) / (F.col("qnorm") * F.col("norm"))).alias("score"))


def probe_top_k(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(item_id, key, score, rank) from each query's nearest ``probes`` cells; ``exact``: and every further cell that may hold one of the k best."""
    if spark.read.parquet(f"{path}/centres").isEmpty():
        return queries.select("item_id", F.lit(None).cast("long").alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    gaps = _gaps(spark, path, queries)
    tried = top_k(_hits(spark, path, queries, gaps.where(F.col("near") <= probes), k, key, column), k, key=key)
    if not exact:
        return tried
    least = tried.groupBy("item_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("item_id", "least")
    need = gaps.join(least, "item_id", "left").where(F.col("least").isNull() | (F.cos("gap") >= F.col("least") - SLACK))
    return top_k(_hits(spark, path, queries, need, k, key, column), k, key=key)


def recall(found: DataFrame, wanted: DataFrame, key: str = "vec_id") -> DataFrame:
    """(item_id, recall): the share of the wanted rows that were found."""
    hit = found.select("item_id", key).withColumn("hit", F.lit(1))
    return wanted.select("item_id", key).join(hit, ["item_id", key], "left").groupBy("item_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
