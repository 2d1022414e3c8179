"""Vectors on an integer lattice: exact distances and exact sums for operators 12 and 13.

A component x becomes floor(scale * x), the scale a power of two, so the product
is exact.  A vector travels as little-endian 32-bit integers, or, where one of
its components needs more, as its own doubles; distances and sums use machine
integers while they provably fit and Python's integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums leave a task in digits of so many bits; a sum over 2^23 tasks fits a long.
DIGIT = 40
_LONG = 1 << 63


def _finite(values) -> np.ndarray | None:
    if values is None:
        return None
    v = np.array([np.nan if x is None else x for x in values] if getattr(values, "dtype", None) == object else values, np.float64)
    return v if np.isfinite(v).all() else None


def _packed(v: np.ndarray, scale: int) -> bytes:
    with np.errstate(over="ignore"):
        low = np.floor(v * scale)
    return low.astype("<i4").tobytes() if (np.abs(low) < 1 << 31).all() else v.astype("<f8").tobytes()


def on_lattice(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id and label as text, size, x) of the vectors that are not null and hold only finite components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for vec, label, values in zip(pdf["vec_id"], pdf["label"], pdf["embedding"], strict=True):
                v = _finite(values)
                if v is not None:
                    rows.append((vec, label, len(v), _packed(v, scale)))
            yield pd.DataFrame(rows, columns=["vec_id", "label", "size", "x"])

    text = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return text.mapInPandas(run, "vec_id string, label string, size int, x binary")


def integers(packed: list[bytes], size: int, scale: int) -> np.ndarray:
    """Rows of ``size`` integers: int64, or Python integers if one row is wide."""
    if all(len(p) == 4 * size for p in packed):
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), size).astype(np.int64)
    out = np.empty((len(packed), size), object)
    for i, p in enumerate(packed):
        if len(p) == 4 * size:
            out[i] = np.frombuffer(p, "<i4").tolist()
        else:
            for j, v in enumerate(np.frombuffer(p, "<f8").tolist()):
                # beyond 2^53 a double is an integer
                out[i, j] = int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale))
    return out


def _top(x: np.ndarray) -> int:
    return int(abs(x).max()) if x.size else 0


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances [row, entry], exact: by products of doubles below 2^53, of longs below 2^63, else of Python integers."""
    room = x.shape[1] * (2 * max(_top(x), _top(book))) ** 2
    if room < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    kind = np.int64 if room < _LONG else object
    a, out = x.astype(kind), np.empty((len(x), len(book)), kind)
    for j, entry in enumerate(book.astype(kind)):
        out[:, j] = ((a - entry) ** 2).sum(1)
    return out


def one_to_one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to the same row of ``y``, exact."""
    kind = np.int64 if x.shape[1] * (2 * max(_top(x), _top(y))) ** 2 < _LONG else object
    return ((x.astype(kind) - y.astype(kind)) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), np.int64)


class Sums:
    """Counts and component sums of one part's entries within a task."""

    def __init__(self, entries: int, size: int):
        self.count = np.zeros(entries, np.int64)
        self.total = np.zeros((entries, size), np.int64)

    def add(self, x: np.ndarray, entry: np.ndarray) -> None:
        self.count += np.bincount(entry, minlength=len(self.count))
        if x.dtype == object and self.total.dtype != object or self.total.size and _top(self.total) > 1 << 61:
            self.total = self.total.astype(object)
        order = np.argsort(entry, kind="stable")
        have, first = np.unique(entry[order], return_index=True)
        if len(have) and x.shape[1]:
            self.total[have] += np.add.reduceat(x[order], first, axis=0)

    def rows(self, part: int) -> Iterator[tuple[int, int, int, int, list[int]]]:
        """(part, entry, digit, count, digits of the sums): what groupBy adds up."""
        rest, digit = self.total, 0
        mask = (1 << DIGIT) - 1
        while digit == 0 or (rest != 0).any():
            sign = np.where(rest < 0, -1, 1)
            now = sign * (abs(rest) & mask)
            for e in np.flatnonzero(self.count).tolist():
                yield part, e, digit, int(self.count[e]) if digit == 0 else 0, [int(v) for v in now[e]]
            rest = sign * (abs(rest) >> DIGIT)
            digit += 1


SUMS = "part int, entry int, digit int, n long, s array<long>"


def merged(sums: DataFrame, size: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to (count, component sums) over all tasks; as many rows as entries reach the driver."""
    parts = sums.groupBy("part", "entry", "digit").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in parts.collect():
        n, total = out.get((r["part"], r["entry"]), (0, [0] * size))
        out[r["part"], r["entry"]] = n + r["n"], [t + (r[f"s{i}"] << DIGIT * r["digit"]) for i, t in enumerate(total)]
    return out


def moved(book: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """The book with each used entry at the componentwise floor of its rows' mean."""
    out = book.astype(object)
    for e, (n, total) in sums.items():
        out[e] = [t // n for t in total]
    return narrow(out)


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if x.dtype == object and _top(x) < 1 << 62 else x


def as_long(values: np.ndarray) -> list[int | None]:
    """Python integers; what no long holds is null."""
    return [int(v) if v < _LONG else None for v in values]
