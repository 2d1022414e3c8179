"""Repeated word passages by fixed-block anchors.

Segments whose anchors recur (see ``repeats``) meet; there, non-overlapping
blocks of ``block`` words are indexed and every rolling window of that size
probes the index.  Each hit is extended word by word, to both sides, against the
first and the nearest place of its block; hits of one repeat extend into each
other, so their union is the maximal exact repeat, and windows of ``length``
words inside it go.  A window always holds a whole block, as
length >= 2 * block - 1.  Windows with a hit that neither place explains (a block
of many contexts) are compared whole with all others of that kind.

Words are 64-bit hashes of their bytes.

Defined results: a null or wordless text has no words; repeats within one
document count; a repeated row is another document, as is one without doc_id; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from docforge.llm.kernels import gram_hashes, word_hashes, word_spans
from docforge.llm.repeats import Symbols, covered, numbered, per_text, recurring_windows

U64 = np.uint64


def _extend(sym: np.ndarray, left: np.ndarray, right: np.ndarray, one: np.ndarray, two: np.ndarray, block: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """How far equal blocks at ``one`` and ``two`` agree before and behind them, ``reach`` words at most, inside their segments."""
    before, behind = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    live = np.arange(len(one))
    for step in range(1, reach + 1):
        live = live[(one[live] - step >= left[one[live]]) & (two[live] - step >= left[two[live]])]
        live = live[sym[one[live] - step] == sym[two[live] - step]]
        before[live] = step
    live = np.arange(len(one))
    for step in range(1, reach + 1):
        a, b = one[live] + block - 1 + step, two[live] + block - 1 + step
        live = live[(a < right[one[live]]) & (b < right[two[live]])]
        live = live[sym[one[live] + block - 1 + step] == sym[two[live] + block - 1 + step]]
        behind[live] = step
    return before, behind


def judge_words(length: int, block: int):
    def judge(segments: list[np.ndarray], texts: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in segments])
        base = np.concatenate(([0], np.cumsum(sizes)))
        sym = np.concatenate(segments)
        n = len(sym)
        owner = np.repeat(np.arange(len(segments)), sizes)
        left, right = base[owner], base[owner] + sizes[owner]
        # one place in a text may stand in two segments (their ends overlap): it is no repeat of itself
        place = (texts[owner] << 40) + starts[owner] + np.arange(n) - left
        probe = gram_hashes(sym, block)
        m = len(probe)
        inside = np.arange(m) - left[:m]
        whole = np.arange(m) + block <= right[:m]
        # index: blocks side by side in each segment; every rolling window probes it
        index = np.unique(probe[whole & (inside % block == 0)])
        at = np.flatnonzero(whole)
        at = at[np.isin(probe[at], index)]
        order = np.argsort(probe[at], kind="stable")
        at = at[order]
        head = np.concatenate(([True], probe[at][1:] != probe[at][:-1])) if len(at) else np.zeros(0, bool)
        first = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        one = np.concatenate((at[~head], at[~head]))
        two = np.concatenate((first[~head], at[np.flatnonzero(~head) - 1]))
        # of a block, its first place was joined with the second only; that is the nearest one to it
        apart = place[one] != place[two]
        one, two = one[apart], two[apart]
        true = (sym[one] == sym[two]) & (sym[one + block - 1] == sym[two + block - 1])
        one, two = one[true], two[true]
        before, behind = _extend(sym, left, right, one, two, block, length - block)
        long = before + behind >= length - block
        lo, hi = before[long], behind[long] + block - length
        mark = np.zeros(n + 1, np.int32)
        for side in (one[long], two[long]):
            np.add.at(mark, side - lo, 1)
            np.add.at(mark, side + hi + 1, -1)
        gone = np.cumsum(mark[:-1]) > 0
        # windows with a hit that no extension covers: equal to another such or covered window word for word
        near = np.zeros(n + 1, np.int32)
        np.add.at(near, np.maximum(at - (length - block), left[at]), 1)
        np.add.at(near, at + 1, -1)
        win = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (np.arange(n) + length <= right))
        if len(win) and not gone[win].all():
            full = gram_hashes(sym, length)[win]
            rank = np.lexsort((place[win], full))
            f, p = full[rank], place[win][rank]
            same = f[1:] == f[:-1]
            other = same & (p[1:] != p[:-1])
            # a class with two places goes
            head = np.concatenate(([True], ~same))
            cls = np.cumsum(head) - 1
            two_places = np.zeros(cls[-1] + 1, bool)
            two_places[cls[1:][other]] = True
            gone[win[rank[two_places[cls]]]] = True
        return [gone[b : b + s - length + 1] for b, s in zip(base, sizes, strict=False)]

    return judge


def _read(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    h = word_hashes(data, *word_spans(data))
    return h, h


def repeated_words(rows: DataFrame, length: int = 35, block: int = 18, gram: int = 12) -> DataFrame:
    """(doc_id, nth, runs) of the word windows that also start elsewhere, for ``numbered`` rows."""
    return recurring_windows(rows, Symbols(_read, gram, length, "uint64", 8), judge_words(length, block))


def word_digests(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, runs in zip(pdf["doc_id"], pdf["text"], pdf["runs"], strict=True):
                raw = (text if isinstance(text, str) else "").encode("utf-8")
                words = raw.split()
                if b"\x1c" in raw or b"\x1d" in raw or b"\x1e" in raw or b"\x1f" in raw:
                    a, z = word_spans(np.frombuffer(raw, np.uint8))
                    words = [raw[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                gone = covered(runs, len(words), length)
                kept = words if not gone.any() else [words[i] for i in np.flatnonzero(~gone)]
                out.append((doc, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = numbered(docs)
    return per_text(rows, repeated_words(rows, length), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
