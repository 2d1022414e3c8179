"""What the training-data operators share: tables, shared folder, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docforge.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole table of ``sf_dir``; the path may be any that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and runs on one machine, as in tests, a
    temporary one is made and set; on a cluster that is an error, as a folder of
    the driver is none of the executors'.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="docforge-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the process
        pass


#: Shuffle files of a finished write are of no further use: its result stands in the shared folder.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/docforge-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove what ``cut`` wrote for ``df``, once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/docforge-" in f:
            _forget(df.sparkSession, f)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint) as (id, comp = least id).

    Alternating large-star and small-star steps over DataFrames; nothing is
    collected but one checksum a round.  Each round is written to the shared
    folder.  Nodes without an edge to another node do not appear.
    """
    have = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = have.select("a", "b").union(have.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        old, have = have, cut(small)
        drop_cut(old)
        state = have.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    tops = have.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("id"), "comp")
    return tops.union(tops.select(F.col("comp").alias("id"), "comp").distinct())


def least_rows(df: DataFrame, by: str, order: list[str], n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each value of ``by`` in ``order``, first within salts, so no value fills a task."""
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(salts)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_s").orderBy(*order))).where(F.col("_r") <= n)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_s")


class Forest:
    """Union-find over small integers, least root first."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
