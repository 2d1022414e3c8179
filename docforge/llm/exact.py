"""Exact duplicates through a cuckoo-filter index of live digests.

Two texts are equal when they agree after every character of
``[\\x20\\x09-\\x0D]`` is deleted.  The JVM digests each whole text once; what
moves afterwards is one short row per document.  Rows are first combined by
(digest, salt), so a group that holds a third of the table reaches the index as
``salts`` rows at most, and the result goes back over the same salted key.

Defined results: a null text counts as empty; empty texts form one group;
repeated rows with one doc_id are each a row; ties on length go to the least
doc_id, a missing one comes last; an empty table gives an empty table; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.llm.common import cut, fresh

#: Characters that do not count.
GAPS = " \t\n\x0b\x0c\r"
#: Stands for a missing doc_id, after all others.
NO_ID = (1 << 63) - 1


class CuckooIndex:
    """Live keys behind a cuckoo filter.

    The filter holds ``slots`` fingerprints a bucket and answers first: a key
    whose fingerprint stands in neither of its two buckets is not live.  A hit is
    verified against the content of the key's bucket, a short list of whole keys
    and their values.  Where an insertion finds no room after ``kicks`` moves, the
    filter doubles and is filled again from the stored keys.
    """

    def __init__(self, buckets: int = 1 << 10, slots: int = 4, kicks: int = 200):
        self.slots, self.kicks, self.size = slots, kicks, 0
        self.content: list[list[list]] = [[]]
        self._resize(buckets)

    def _resize(self, buckets: int) -> None:
        """As many buckets, or more, all filled from the stored keys."""
        stored = [entry for row in self.content for entry in row]
        while True:
            self.mask = buckets - 1
            self.marks: list[list[int]] = [[] for _ in range(buckets)]
            self.content = [[] for _ in range(buckets)]
            if all(self._mark(entry[0]) for entry in stored):
                break
            buckets *= 2
        for entry in stored:
            self.content[self._places(entry[0])[1]].append(entry)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        one = int.from_bytes(key[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & self.mask

    def _mark(self, key: bytes) -> bool:
        """Put the key's fingerprint in, moving others to their second bucket where both are full."""
        mark, one, two = self._places(key)
        for at in (one, two):
            if len(self.marks[at]) < self.slots:
                self.marks[at].append(mark)
                return True
        at = two
        for turn in range(self.kicks):
            row = self.marks[at]
            spot = (turn + mark) % self.slots
            mark, row[spot] = row[spot], mark
            at = self._other(at, mark)
            if len(self.marks[at]) < self.slots:
                self.marks[at].append(mark)
                return True
        return False

    def _entry(self, key: bytes) -> list | None:
        mark, one, two = self._places(key)
        if mark in self.marks[one] or mark in self.marks[two]:
            for entry in self.content[one]:
                if entry[0] == key:
                    return entry
        return None

    def maybe(self, key: bytes) -> bool:
        """What the filter alone says."""
        mark, one, two = self._places(key)
        return mark in self.marks[one] or mark in self.marks[two]

    def get(self, key: bytes):
        """The value of a live key, or None."""
        entry = self._entry(key)
        return entry[1] if entry else None

    def put(self, key: bytes, value) -> None:
        entry = self._entry(key)
        if entry:
            entry[1] = value
            return
        fits = self._mark(key)
        self.content[self._places(key)[1]].append([key, value])
        self.size += 1
        if not fits:
            self._resize((self.mask + 1) * 2)

    def delete(self, key: bytes) -> bool:
        """Whether the key was live; now it is not."""
        entry = self._entry(key)
        if not entry:
            return False
        mark, one, two = self._places(key)
        self.content[one].remove(entry)
        self.marks[one if mark in self.marks[one] else two].remove(mark)
        self.size -= 1
        return True


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial groups of a digest, side by side, become one; emit each partial's group.

    Rows come sorted by the digest's slice, so an index holds one slice only
    and is dropped with it.
    """
    index, held, slice_now, rows = CuckooIndex(), [], None, []

    def frame() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["digest", "salt", "keep_id", "group_size"])

    def close() -> None:
        for digest, salt in held:
            (_, low), size = index.get(digest)
            rows.append((digest, salt, -low, size))

    for pdf in batches:
        for part, digest, salt, n, size, low in zip(pdf["part"], pdf["digest"], pdf["salt"], pdf["n"], pdf["size"], pdf["low"], strict=True):
            if part != slice_now:
                close()
                index, held, slice_now = CuckooIndex(), [], part
                if len(rows) >= 10_000:
                    yield frame()
                    rows = []
            digest = bytes(digest)
            best, old = (n, -low), index.get(digest)
            if old is not None:
                index.delete(digest)
                best, size = max(best, old[0]), size + old[1]
            index.put(digest, (best, size))
            held.append((digest, salt))
    close()
    yield frame()


def _normal(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), GAPS, ""), 256))


def exact_groups(docs: DataFrame, salts: int = 64, per_index: int = 100_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    The digests are dealt into slices of ``per_index`` rows on average, so that
    an index, which holds one slice at a time, does not grow with the table.
    """
    keyed = cut(
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
            _normal(F.col("text")).alias("digest"),
            F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"),
            F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int").alias("salt"),
        )
    )
    slices = max(256, -(-keyed.count() // per_index))
    partial = keyed.groupBy("digest", "salt").agg(F.count("*").alias("size"), F.max(F.struct("n", (-F.col("doc_id")).alias("m"))).alias("b"))
    partial = partial.select("digest", "salt", "size", F.col("b.n").alias("n"), (-F.col("b.m")).alias("low"), F.pmod(F.xxhash64("digest"), F.lit(slices)).cast("int").alias("part"))
    groups = partial.repartition("part").sortWithinPartitions("part").mapInPandas(_merge, "digest binary, salt int, keep_id long, group_size long")
    own, keep = F.nullif("doc_id", F.lit(NO_ID)), F.nullif("keep_id", F.lit(NO_ID))
    return keyed.join(groups, ["digest", "salt"]).select(own.alias("doc_id"), keep.alias("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with its columns: the longest as written, then of the least doc_id.

    Of rows that share that doc_id and text, one stays (the longest as written,
    then the greatest text, then any).
    """
    own, digest, rows, rank = fresh(docs, "stay", "digest", "rows", "rank")
    stay = exact_groups(docs).where("kept").groupBy(F.col("doc_id").alias(own), F.unhex("text_sha256").alias(digest)).agg(F.count("*").alias(rows))
    # a table of short rows, read again where some row is given twice
    stay = cut(stay)
    mine = F.col("doc_id").eqNullSafe(F.col(own))
    if stay.where(F.col(rows) > 1).isEmpty():
        # doc_id alone may name two groups, so the text decides too
        same = mine & (_normal(docs["text"]) == F.col(digest))
        return docs.join(stay, same, "left_semi")
    first = Window.partitionBy(own, digest).orderBy(F.char_length("text").desc_nulls_last(), F.col("text").desc_nulls_last())
    met = docs.join(stay, mine & (_normal(docs["text"]) == F.col(digest)))
    return met.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(own, digest, rows, rank)
