"""Continuous forms of batch steps (an extension: the batch ones are the model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docforge.operators.bucketed import BucketStore


def ingest_stream(docs: DataFrame, store: BucketStore, stamp: dict, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of documents goes through the incremental index; of an id that comes twice in one batch, the greater text counts.

    A batch that is run again finds its documents unchanged and writes nothing.
    """

    def one(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c != "doc_id"]
        last = batch.groupBy("doc_id").agg(F.max(F.struct("text", *(c for c in rest if c != "text"))).alias("r"))
        store.ingest(last.select("doc_id", "r.*").select(batch.columns), stamp)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by window and type, late rows up to a watermark."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
