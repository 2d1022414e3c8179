"""The incremental index in hash buckets: an ingest writes only buckets that change.

Each chunker has a store of its own, ``<path>/<chunker>``: ``chunks`` and ``docs``
(doc_id, hash, chunks), both in one folder a bucket of the document's id.  Changes
are found from ``docs`` alone, and touched buckets are replaced by dynamic
partition overwrite; files of all others stay as they are.  ``_pending`` names the
buckets that a writer has begun: after a writer that stopped midway, the next one
rebuilds them from its documents.  Ingesting the same documents again finds
nothing to do, so a micro-batch that is run twice changes nothing.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.operators.chunking import chunk_rows
from docforge.operators.relate import diff
from docforge.operators.store import content_hash, mismatches

_CHUNKS = "doc_id long, chunk_id string, hash string, start long, end long, tokens long, text string, bucket string"
_DOCS = "doc_id long, hash string, chunks long, bucket string"
_REPORT = ("new", "changed", "unchanged")


def bucket_of(key: Column, digits: int = 2) -> Column:
    """One of 16 ** ``digits`` buckets: the first hex digits of the id's md5."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, digits)


class BucketStore:
    """One chunker's store under ``path``; ``digits`` (2: 256 buckets) grows with the corpus and stays with the store."""

    def __init__(self, spark: SparkSession, path: str, chunker: str = "fixed", digits: int = 2):
        self.spark, self.chunker, self.digits, self.path = spark, chunker, digits, f"{path.rstrip('/')}/{chunker}"

    def _line(self, name: str) -> dict | None:
        try:
            rows = self.spark.read.text(f"{self.path}/{name}").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return json.loads(rows[0][0]) if rows else None

    def _put(self, name: str, value: dict) -> None:
        self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def chunks(self) -> DataFrame:
        return self._table("chunks", _CHUNKS)

    def docs(self) -> DataFrame:
        return self._table("docs", _DOCS)

    def stamp(self) -> dict | None:
        return self._line("_stamp")

    def files(self) -> dict[str, list[str]]:
        """Bucket to its chunk files: as many names as the store has files."""
        rows = self.chunks().select("bucket", F.input_file_name().alias("f")).distinct().groupBy("bucket").agg(F.sort_array(F.collect_set("f")).alias("f")).collect()
        return {r["bucket"]: r["f"] for r in rows}

    def _replace(self, name: str, df: DataFrame, fresh: bool) -> None:
        out = df.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").mode("overwrite")
        (out if fresh else out.option("partitionOverwriteMode", "dynamic")).parquet(f"{self.path}/{name}")

    def _drop(self, name: str, buckets: list[str]) -> None:
        """Overwriting leaves a bucket alone that has no rows left: its folder goes."""
        for b in buckets:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/bucket={b}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def ingest(self, docs: DataFrame, stamp: dict, prune: bool = False) -> dict:
        """Chunk what is new or changed in text or any other column; counts by change, reasons of a rebuild, buckets written.

        ``docs`` (doc_id, text, ...), a row an id.  Another stamp rebuilds all;
        ``prune`` removes documents that ``docs`` lacks.
        """
        have, lost = self.stamp(), (self._line("_pending") or {}).get("buckets", [])
        reasons = ["no store yet"] if have is None else mismatches(stamp, have) + [f"{k}: index has {have[k]!r}, code has none" for k in sorted(have.keys() - stamp.keys())]
        more = sorted(c for c in docs.columns if c not in ("doc_id", "text"))
        bucket = bucket_of(F.col("doc_id"), self.digits).alias("bucket")
        hashed = docs.withColumn("hash", content_hash(F.col("text"), *(F.to_json(F.struct(c)) for c in more))).select("*", bucket)
        fresh = bool(reasons)
        if fresh:
            out, todo, by = None, hashed, hashed.groupBy("bucket").count().withColumn("change", F.lit("new")).collect()
        else:
            old = self.docs().withColumn("hash", F.when(F.col("bucket").isin(lost), "").otherwise(F.col("hash")))
            changes = diff(old.select("doc_id", "hash"), hashed)
            by = changes.groupBy(bucket, "change").count().collect()  # at most four rows a bucket
            out = changes.where(F.col("change").isin(["changed", "removed"] if prune else ["changed"])).select("doc_id")
            todo = hashed.join(changes.where("change in ('new', 'changed')").select("doc_id"), "doc_id", "left_semi")
        acts = ("new", "changed", "removed") if prune else ("new", "changed")
        report = {c: sum(r["count"] for r in by if r["change"] == c) for c in (*_REPORT, *acts[2:])}
        touched = sorted({r["bucket"] for r in by if r["change"] in acts})
        report |= {"rebuilt": fresh, "reasons": reasons, "buckets": len(touched)}
        if not touched and not fresh:
            return report
        self._put("_pending", {"buckets": sorted({*touched, *lost})})
        shape = ["doc_id", "chunk_id", "hash", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "tokens")), "text", "bucket"]
        made = chunk_rows(todo, self.chunker).join(todo.select("doc_id", "hash", "bucket"), "doc_id").select(shape)
        listed = todo.select("doc_id", "hash", "bucket")
        if out is not None:
            stay = lambda t: t.where(F.col("bucket").isin(touched)).join(out, "doc_id", "left_anti")
            made, listed = stay(self.chunks()).select(made.columns).unionByName(made), stay(self.docs()).select(listed.columns).unionByName(listed)
        self._replace("chunks", made, fresh)
        # a bucket without new rows still has its old ones, under other hashes
        counts = self.chunks().where(F.col("bucket").isin(touched)).groupBy("doc_id", "hash").agg(F.count("*").alias("chunks"))
        self._replace("docs", listed.join(counts, ["doc_id", "hash"], "left").select("doc_id", "hash", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), "bucket"), fresh)
        if not fresh:
            full = {r["bucket"] for r in by if r["change"] in (("new", "changed", "unchanged") if prune else (*_REPORT, "removed"))}
            self._drop("docs", [b for b in touched if b not in full])
            held = {r["bucket"] for r in self.docs().where(F.col("bucket").isin(touched) & (F.col("chunks") > 0)).select("bucket").distinct().collect()}
            self._drop("chunks", [b for b in touched if b not in held])
        self._put("_stamp", stamp)
        self._put("_pending", {"buckets": sorted(set(lost) - set(touched))})
        return report
