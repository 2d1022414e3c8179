"""Incremental index maintenance by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.operators.chunking import chunk_rows
from docforge.operators.relate import diff
from docforge.sources.files import VersionedTable


def content_hash(text: Column, *metadata: Column) -> Column:
    """Sixteen hex digits of text and metadata; either changing changes it."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce(text, F.lit("")), *(F.coalesce(m.cast("string"), F.lit("")) for m in metadata)), 256), 1, 16)


def mismatches(stamp: dict, have: dict) -> list[str]:
    """Why an index with the stamp ``have`` cannot serve code with ``stamp``; empty: it can."""
    return [f"{k}: index has {have.get(k)!r}, code has {v!r}" for k, v in stamp.items() if have.get(k) != v]


def status(index: DataFrame | None, docs: DataFrame, stamp: dict, have: dict) -> tuple[DataFrame | None, bool]:
    """Counts by change, and whether the index is fresh (further documents do not matter)."""
    if index is None or stamp != have:
        return None, False
    counts = diff(index.select("doc_id", "hash").distinct(), docs).groupBy("change").count()
    return counts, counts.where("change in ('new', 'changed')").isEmpty()


def ingest(table: VersionedTable, docs: DataFrame, stamp: dict, chunker: str = "fixed", prune: bool = False) -> dict[str, int]:
    """Chunk what is new or changed in text or any other column, keep the rest, swap the snapshot; a stamp mismatch rebuilds all."""
    old = table.read() if table.stamp() == stamp else None
    more = sorted(c for c in docs.columns if c not in ("doc_id", "text"))
    hashed = docs.withColumn("hash", content_hash(F.col("text"), *(F.to_json(F.struct(c)) for c in more)))
    if old is None:
        changes, todo, kept = None, hashed, None
    else:
        changes = diff(old.select("doc_id", "hash").distinct(), hashed)
        gone = ["changed", "removed"] if prune else ["changed"]
        todo = hashed.join(changes.where("change in ('new', 'changed')").select("doc_id"), "doc_id", "left_semi")
        kept = old.join(changes.where(F.col("change").isin(gone)).select("doc_id"), "doc_id", "left_anti")
    made = chunk_rows(todo, chunker).join(todo.select("doc_id", "hash"), "doc_id").select("chunk_id", "doc_id", "hash", "start", "end", "tokens", "text")
    counts = {"new": hashed.count()} if changes is None else {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    table.write(made if kept is None else kept.unionByName(made), stamp)
    return counts
