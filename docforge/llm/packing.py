"""Packing of whole documents into fixed windows by multiway differencing.

A document's ids, closed by id 0, are cut into full windows and a rest; rests
are cut to at most ``grain`` ids.  In each task the rests of some ``group``
documents are packed together: every piece starts as its own partial partition
of k windows, and the two partials with the widest imbalance are merged again
and again, largest windows onto smallest, which leaves near-equal windows.
k starts at the least number that could hold the ids and rises whenever a
window exceeds the capacity.  Packing needs no shuffle, and a task that is run
again gives the same sequences (their ids derive from the partition).

Defined results: a null text is an empty one, which is id 0 alone; no input
rows, no sequences; repeated rows are packed each; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, object] = {}


def encoder(path: str):
    """A byte-level BPE from a tokenizers JSON file; its marked specials stay single ids."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        _encoders[path] = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp: k windows as (total, item numbers), totals near equal."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, [[]] * (k - 1) + [[i]]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, one, mine = heapq.heappop(heap)
        _, _, two, others = heapq.heappop(heap)
        sums = one + two[::-1]
        held = [a + b if b else a for a, b in zip(mine, reversed(others), strict=True)]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), serial, sums, [held[j] for j in order]))
        serial += 1
    _, _, sums, held = heap[0]
    return list(zip(sums.tolist(), held, strict=True))


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, none over ``capacity``; k rises until that holds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        got = difference(sizes, k)
        if max(s for s, _ in got) <= capacity:
            return [items for _, items in got if items]
        k += max(1, k // 200)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, group: int = 384, grain: int = 256) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, rows, rests = encoder(path), [], []
        base = TaskContext.get().partitionId() << 36
        serial = 0

        def frame() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def close() -> None:
            nonlocal serial, rests
            if rests:
                for items in pack([r[2] for r in rests], capacity):
                    at = 0
                    for j in sorted(items):
                        rows.append((*rests[j], base + serial, at))
                        at += rests[j][2]
                    serial += 1
            rests = []

        waiting = 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*(enc.encode(text, allowed_special="all") if isinstance(text, str) and text else ()), 0], "<u4")
                n = len(ids)
                full = n - n % capacity
                for at in range(0, full, capacity):
                    rows.append((doc, at, capacity, zlib.crc32(ids[at : at + capacity]), n, base + serial, 0))
                    serial += 1
                for at in range(full, n, grain):
                    size = min(grain, n - at)
                    rests.append((doc, at, size, zlib.crc32(ids[at : at + size]), n))
                waiting += full < n
                if waiting >= group:
                    close()
                    waiting = 0
                if len(rows) >= 20_000:
                    yield frame()
                    rows = []
        close()
        yield frame()

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
