"""Compression of vectors to one code per part, codebooks by Yinyang Lloyd.

Each part position has a codebook of up to 256 entries; its entries are
clustered once into groups.  A vector keeps, for every part, its entry and one
lower bound a group: no entry of that group but its own is nearer.  When the
codebook moves, a bound falls by the largest move within its group; a group is
scanned only where its fallen bound no longer exceeds the exact distance to the
vector's own entry.  Distances of scanned entries are integers, so ties go to the
lower index exactly.  Bounds and entries are written with the vectors each round
(in the shared folder) together with each task's counts and sums, which groupBy
merges: a round is one pass, and no row is shuffled.

Defined results: rows whose vector is null or holds null or non-finite components
are left out.  The width is that of the vector with the smallest id; a vector of
another width, or all if that is no multiple of the parts, gets a null code and
error.  Rows without a vec_id are coded but start no entry; repeated rows count as
often as they stand, of starts with one id the lesser stored bytes come first; with
fewer than 256 kept vectors there are as many entries; an empty table gives an
empty one; further columns are ignored; an error beyond a long is null and adds
nothing to its label's, and a label's sum beyond one is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import cut, drop_cut
from docforge.llm.lattice import SUMS, Sums, as_long, integers, merged, moved, narrow, on_lattice, one_to_one, squared

STATE = f"vec_id string, label string, x binary, state binary, code string, error long, scanned long, {SUMS}"
_COLUMNS = ["vec_id", "label", "x", "state", "code", "error", "scanned", "part", "entry", "digit", "n", "s"]
#: As many label sums as may be broadcast.
LABELS = 20_000


def groups_of(book: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A group number for each entry: few Lloyd rounds over the entries themselves, farthest-first starts."""
    x = book.astype(np.float64) if book.dtype != object else np.vectorize(_float, [np.float64])(book)
    n = min(n, len(x))
    picked = [0]
    with np.errstate(all="ignore"):  # any grouping is right, a poor one only prunes less
        gap = ((x - x[0]) ** 2).sum(1)
        while len(picked) < n:
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(1))
        centre = x[picked]
        for _ in range(rounds):
            group = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            for g in range(n):
                if (group == g).any():
                    centre[g] = x[group == g].mean(0)
    return group


def _float(v: int) -> float:
    try:
        return float(v)
    except OverflowError:
        return np.inf if v > 0 else -np.inf


def _root(squares: np.ndarray) -> np.ndarray:
    """The square root in float32, half a step off at most."""
    wide = squares.dtype == object
    with np.errstate(over="ignore"):
        return np.sqrt(np.array([_float(v) for v in squares.ravel().tolist()], np.float64).reshape(squares.shape) if wide else squares.astype(np.float64)).astype(np.float32)


def _below(squares: np.ndarray) -> np.ndarray:
    """A lower bound of the square root."""
    return np.nextafter(_root(squares), np.float32(0))


def _above(squares: np.ndarray) -> np.ndarray:
    """An upper bound of the square root."""
    return np.nextafter(_root(squares), np.float32(np.inf))


def _rest(far: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A lower bound of each row's distances but those that ``own`` marks; none left: infinity."""
    return np.where(own, np.float32(np.inf), _below(far)).min(1)


class Bounds:
    """One part position's codebook, its groups, and how far each group may have come nearer since the last pass."""

    def __init__(self, book: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.book, self.group = book, group
        self.members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
        self.drift = np.zeros(len(self.members), np.float32)
        if before is not None:
            move = _above(one_to_one(book, before))
            self.drift = np.array([move[m].max() if len(m) else 0 for m in self.members], np.float32)

    def assign(self, x: np.ndarray, own: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, squared distance, bound of each group, entries scanned); ``own`` and ``low`` are the last pass's, None in the first."""
        rows, n = np.arange(len(x)), len(self.members)
        if own is None:
            far = squared(x, self.book)
            best = far.argmin(1)
            own_one = np.arange(len(self.book)) == best[:, None]
            low = np.stack([_rest(far[:, m], own_one[:, m]) if len(m) else np.full(len(x), np.inf, np.float32) for m in self.members], 1)
            return best, far[rows, best], low, far.size
        best, exact = own.copy(), one_to_one(x, self.book[own])
        with np.errstate(invalid="ignore"):
            low = np.maximum(np.nextafter(low - self.drift, np.float32(-np.inf)), 0)
        scanned = len(x)
        # a group may hold an entry as near as the own one only where its bound is not above that distance
        fails = low <= _above(exact)[:, None]
        for g in range(n):
            at = np.flatnonzero(fails[:, g])
            at = at[low[at, g] <= _above(exact[at])]  # an earlier group may have brought it nearer
            m = self.members[g]
            if not len(at) or not len(m):
                continue
            far = squared(x[at], self.book[m])
            scanned += far.size
            spot = far.argmin(1)
            near, found, held = far[np.arange(len(at)), spot], m[spot], best[at]
            wins = ((near < exact[at]) | (near == exact[at]) & (found < held)).astype(bool)
            low[at, g] = _rest(far, m == np.where(wins, found, held)[:, None])
            won, left, gone = at[wins], self.group[held[wins]], _below(exact[at[wins]])
            best[won], exact[won] = found[wins], near[wins]
            low[won, left] = np.minimum(low[won, left], gone)  # an entry given up counts in its group again
        return best, exact, low, scanned


def _pass(books: list[Bounds], size: int, scale: int, first: bool, last: bool):
    """Rows with bounds, and after them this task's sums; the last pass gives codes instead."""
    parts = len(books)
    wide = size // parts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [Sums(len(b.book), wide) for b in books]
        for pdf in batches:
            if not len(pdf):
                continue
            x = integers(pdf["x"].to_list(), size, scale)
            old = None if first else pdf["state"].to_list()
            entries, state, error, scanned, at = [], [], 0, 0, 0
            for p, b in enumerate(books):
                own = low = None
                mine = narrow(x[:, p * wide : (p + 1) * wide])
                if old is not None:
                    end = at + 1 + 4 * len(b.members)
                    raw = np.frombuffer(b"".join([o[at:end] for o in old]), np.uint8).reshape(len(old), -1)
                    own, low, at = raw[:, 0].astype(np.int64), np.ascontiguousarray(raw[:, 1:]).view("<f4"), end
                best, exact, low, n = b.assign(mine, own, low)
                entries.append(best)
                scanned += n
                if last:
                    error = error + exact.astype(object)
                else:
                    sums[p].add(mine, best)
                    state.append(np.concatenate((best.astype(np.uint8)[:, None], low.astype("<f4").view(np.uint8)), 1))
            out = pdf[["vec_id", "label"]].assign(x=None, state=None, code=None, error=pd.array([None] * len(pdf), "Int64"), scanned=0, part=None, entry=None, digit=None, n=None, s=None)
            out["scanned"] = [scanned] + [0] * (len(pdf) - 1)
            if last:
                out["code"], out["error"] = [bytes(c).hex() for c in np.stack(entries, 1).astype(np.uint8)], pd.array(as_long(error), "Int64")
            else:
                out["x"], out["state"] = pdf["x"], [r.tobytes() for r in np.concatenate(state, 1)]
            yield out[_COLUMNS]
        if not last:
            rows = [(None, None, None, None, None, None, None, *r) for p, own in enumerate(sums) for r in own.rows(p)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _starts(rows: DataFrame, n: int) -> list:
    """The rows of the smallest ids."""
    return rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("v"), "size", "x").orderBy("v", "size", "x").limit(n).collect()


def learn(rows: DataFrame, size: int, parts: int, entries: int, groups: int, rounds: int, scale: int, scans: list[int] | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows with code and error, final codebooks); ``scans`` receives the number of distances of each pass."""
    wide = size // parts
    first = integers([bytes(r["x"]) for r in _starts(rows, entries)], size, scale)
    books = [narrow(first[:, p * wide : (p + 1) * wide]) for p in range(parts)]
    group = [groups_of(b, groups) for b in books]
    bounds = [Bounds(b, g) for b, g in zip(books, group, strict=True)]
    now = rows.withColumn("state", F.lit(None).cast("binary"))
    for turn in range(rounds + 1):
        last = turn == rounds
        old, now = now, cut(now.select("vec_id", "label", "x", "state").mapInPandas(_pass(bounds, size, scale, turn == 0, last), STATE))
        if turn:
            drop_cut(old)
        if scans is not None:
            scans.append(now.agg(F.sum("scanned")).first()[0])
        if not last:
            got = merged(now.where("part is not null").select("part", "entry", "digit", "n", "s"), wide)
            now = now.where("part is null")
            made = [moved(b, {e: v for (q, e), v in got.items() if q == p}) for p, b in enumerate(books)]
            bounds = [Bounds(b, g, was) for b, g, was in zip(made, group, books, strict=True)]
            books = made
    return now.select("vec_id", "label", "code", "error"), books


def _with_label_sums(coded: DataFrame, salts: int = 64) -> DataFrame:
    """``label_error`` beside each row: few sums go to the rows by broadcast, more meet them by label and salt."""
    sums = cut(coded.groupBy("label").agg(F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0)).try_cast("bigint").alias("label_error")).withColumnRenamed("label", "own"))
    if sums.count() <= LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("own")), "left").drop("own")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    spread = sums.withColumn("salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("salt2")), "left").drop("own", "salt", "salt2")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, groups: int = 16, rounds: int = 4, scale: int = 1024, scans: list[int] | None = None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row whose vector is whole."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number is one byte")
    rows = cut(on_lattice(vectors, scale))
    head = _starts(rows, 1)
    size = head[0]["size"] if head else 0
    if not head or not size or size % parts:
        coded, text = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), ""
    else:
        fit = rows.where(F.col("size") == size)
        coded, books = learn(fit, size, parts, entries, groups, rounds, scale, scans)
        text = ",".join(str(v) for b in books for entry in b.tolist() for v in entry)
        odd = rows.where(F.col("size") != size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        coded = coded.unionByName(odd)
    out = _with_label_sums(coded).withColumn("vec_id", F.col("vec_id").cast("long"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
