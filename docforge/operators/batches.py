"""The best rows of many queries, kept in each task while batches of rows pass.

A task scores one batch against all queries and lets a row out only where it may
still be among a query's best k of that task, so neither pairs nor their sums are
sorted, hashed or shuffled: memory is a batch by queries.  ``retrieve.top_k`` then
ranks what all tasks let out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores are ranked by ten digits: a row this little below the k-th may still tie with it.
TIE = 2e-10
#: Cells (queries by rows) of a batch that are scored at once.
CELLS = 1 << 22


class Best:
    """The k best scores a query of the rows seen so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.scores = k, np.full((queries, k), -np.inf)

    def take(self, scores: np.ndarray, keys: pa.Array, slack: float = TIE) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of ``scores`` [query, row] that may be among the best; -inf is no pair.

        Of rows with one score the k least keys are enough.
        """
        both = np.concatenate([self.scores, scores], 1)
        self.scores = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k :]
        q, row = np.nonzero((scores >= self.scores.min(1)[:, None] - slack) & (scores > -np.inf))
        own = np.asarray(pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="first"))[row]
        order = np.lexsort((own, -scores[q, row], q))
        q, row = q[order], row[order]
        value = scores[q, row]
        new = np.r_[True, (q[1:] != q[:-1]) | (value[1:] != value[:-1])] if len(q) else np.zeros(0, bool)
        at = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        return q[at < self.k], row[at < self.k]


def cosine_task(queries: np.ndarray, ids: pa.Array, k: int, key: str, column: str, cells: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: (item_id, key, score) of the vectors that may be among each query's k nearest.

    Products of blocks choose; what is let out has its cosine summed component by
    component in order, as the expressions of ``retrieve`` do, so equal vectors
    score alike.  With ``cells`` [query, cell] a query meets only vectors of the
    cells (column ``cell``) marked for it.  Vectors of another length or with
    null components have no score and come after all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms, best, dim = np.sqrt(_ordered(queries, queries)), Best(len(queries), k), queries.shape[1]
        step = max(1, CELLS // max(1, len(queries)))
        spare: list[pa.Array] = []
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                part = whole.slice(lo, step)
                keys, got = part.column(key), part.column(column)
                good = np.array([v is not None and len(v) == dim for v in got.to_numpy(zero_copy_only=False)], bool)
                if good.any():
                    good[good] = pc.is_valid(got.filter(pa.array(good)).flatten()).to_numpy(zero_copy_only=False).reshape(-1, dim).all(1)
                at = np.nonzero(good)[0]
                rows = got.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                with np.errstate(all="ignore"):
                    length = np.sqrt(_ordered(rows, rows))
                    scores = (queries @ rows.T) / (norms[:, None] * length)
                    scores[np.isnan(scores)] = np.inf  # as Spark and DuckDB order them
                    if cells is not None:
                        scores[~cells[:, part.column("cell").to_numpy(zero_copy_only=False)[at]]] = -np.inf
                    q, row = best.take(scores, keys.take(pa.array(at)), 1e-9)
                    exact = _ordered(queries[q], rows[row]) / (norms[q] * length[row])
                yield _table(ids.take(pa.array(q)), keys.take(pa.array(at[row])), pa.array(exact), key)
                if cells is None and not good.all():
                    spare.append(keys.filter(pa.array(~good)))
        if spare:  # the k least are enough to fill a list
            rest = pa.concat_arrays(spare)
            rest = rest.take(pc.sort_indices(rest, null_placement="at_start")[:k])
            n = len(rest)
            yield _table(ids.take(pa.array(np.repeat(np.arange(len(ids)), n))), rest.take(pa.array(np.tile(np.arange(n), len(ids)))), pa.nulls(n * len(ids), pa.float64()), key)

    return run


def product_task(queries: np.ndarray, ids: pa.Array, k: int, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: (item_id, key, score) of the sparse vectors that may be among each query's k best.

    Batches hold (key, slot, value), all of a key one after another; ``queries``
    [query, slot] holds no negative weight.  A query and a vector without a common
    slot are no pair.  Sums are taken again in one order for what is let out, so
    equal vectors score alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, dim = Best(len(queries), k), queries.shape[1]
        step = max(1, CELLS // max(dim, len(queries)))
        for keys, doc, slot, value in _whole(batches, key):
            for lo in range(0, len(keys), step):
                part, n = keys.slice(lo, step), min(step, len(keys) - lo)
                a, b = np.searchsorted(doc, [lo, lo + n])
                at = (doc[a:b] - lo) * dim + slot[a:b]
                held = np.bincount(at, value[a:b], n * dim).reshape(n, dim)
                scores = queries @ held.T
                # of weights above zero alone a common slot is a score above zero
                none = scores <= 0 if (value[a:b] > 0).all() else (queries > 0).astype(float) @ (np.bincount(at, minlength=n * dim).reshape(n, dim) > 0).T == 0
                scores[none] = -np.inf
                q, row = best.take(scores, part, 1e-9)
                some = max(1, CELLS // dim)
                exact = [(queries[q[i : i + some]] * held[row[i : i + some]]).sum(1) for i in range(0, len(q), some)]
                yield _table(ids.take(pa.array(q)), part.take(pa.array(row)), pa.array(np.concatenate([np.zeros(0), *exact])), key)

    return run


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, number of its key for each row, slots, values) of whole keys: the last one of a batch waits for the next batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and rest[-1].column(key)[-1] != batch.column(key)[0]:
            yield _numbered(rest, key)
            rest = []
        runs = _runs(batch.column(key))
        if len(runs) > 1:
            yield _numbered([*rest, batch.slice(0, runs[-1])], key)
            rest = [batch.slice(runs[-1])]
        else:
            rest.append(batch)
    if rest:
        yield _numbered(rest, key)


def _runs(keys: pa.Array) -> np.ndarray:
    """Where runs of equal keys begin."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.r_[0, 1 + np.nonzero(np.diff(codes))[0]]


def _numbered(parts: list[pa.RecordBatch], key: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    keys, slot, value = (pa.concat_arrays([p.column(c) for p in parts]) for c in (key, "slot", "value"))
    runs = _runs(keys)
    doc = np.repeat(np.arange(len(runs)), np.diff(np.r_[runs, len(keys)]))
    return keys.take(pa.array(runs)), doc, slot.to_numpy(zero_copy_only=False).astype(np.int64), value.to_numpy(zero_copy_only=False)


def _table(ids: pa.Array, keys: pa.Array, scores: pa.Array, key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, keys, scores], ["item_id", key, "score"])


def _ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out
