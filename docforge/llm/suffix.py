"""Substring duplicates by suffix arrays over bytes, built by two-stage sorting.

Pieces of text whose anchors recur (see ``repeats``) are laid end to end; the
suffixes smaller than their successors are sorted directly, all others are
induced from them by one scan over the 256 buckets, and common prefixes of
neighbours in the order show which strings of ``length`` bytes are equal.

Defined results: a null text is empty; matches never cross documents; of equal
strings the one with the least (doc_id, start) stays; of rows that repeat a
doc_id the one with the lesser text comes first, so a row given twice keeps its
first copy whole; a missing doc_id comes before all others; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from docforge.llm.kernels import BYTE_WORD, gram_hashes
from docforge.llm.repeats import Symbols, covered, numbered, per_text, recurring_windows

U64 = np.uint64


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes from every position, big end first, so numbers order like bytes."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    out = np.zeros(n + depth + 8, U64)
    for j in range(8):
        out |= padded[j : j + len(out)].astype(U64) << U64(56 - 8 * j)
    return out


def _direct(at: np.ndarray, words: np.ndarray, depth: int, text: np.ndarray) -> np.ndarray:
    """Positions sorted by their first ``depth`` bytes, eight at a time, ties refined only.

    Copies are sorted once: of positions whose ``depth`` bytes have one hash, the
    first stands for all.  ``common`` compares the bytes themselves afterwards.
    """
    if not len(at):
        return at
    grams = gram_hashes(BYTE_WORD[np.concatenate((text, np.zeros(depth, np.uint8)))], depth)[at]
    by = np.argsort(grams)
    head = np.concatenate(([True], grams[by][1:] != grams[by][:-1]))
    rank = np.empty(int(head.sum()), np.int64)
    rank[_refine(at[by[head]], words, depth)] = np.arange(len(rank))
    copy_of = np.empty(len(at), np.int64)
    copy_of[by] = np.cumsum(head) - 1
    return at[np.argsort(rank[copy_of])]


def _refine(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The order of the ``depth`` bytes that stand ``at``: eight at once, then five with the number of their tie."""
    w = words[at]
    order = np.argsort(w)
    new = np.concatenate(([True], w[order][1:] != w[order][:-1]))
    for step in range(8, depth, 5):
        tied = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
        if not len(tied):
            break
        part, tie = order[tied], np.cumsum(new[tied]).astype(U64)
        w = words[at[part] + step] >> U64(24)
        if tie[-1] < 1 << 24:
            w |= tie << U64(40)
            by = np.argsort(w)
        else:
            by = np.lexsort((w, tie))
        order[tied], w, tie = part[by], w[by], tie[by]
        # a new tie starts where either changes; firsts of old ties stay firsts
        new[tied] = np.concatenate(([True], (tie[1:] != tie[:-1]) | (w[1:] != w[:-1])))
    return order


def two_stage(text: np.ndarray, depth: int, words: np.ndarray | None = None, ends: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The suffix array of a byte text, right to the first ``depth`` bytes at least.

    ``ends``: (the segment of every position, each segment's last position asked
    for).  Then only suffixes asked for are sorted, and those that they are
    induced from: up to the next one that is smaller than its successor.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    # type: compare with the successor; within a run of equal bytes, as at its end
    t = text.astype(np.int16)
    diff = np.concatenate((t[1:] - t[:-1], np.array([-1], np.int16)))  # the end is larger than nothing
    at = np.arange(n)
    where = np.where(diff != 0, at, n - 1)
    nxt = np.minimum.accumulate(where[::-1])[::-1]
    small = diff[nxt] > 0
    if ends is not None:
        segment, last = ends
        next_small = np.minimum.accumulate(np.where(small, at, n - 1)[::-1])[::-1]
        asked = at <= next_small[last][segment]
        small &= asked
        t[~asked] = -1  # of no bucket, so nothing induces it
    words = _words(text, depth) if words is None else words
    sorted_small = _direct(np.flatnonzero(small), words, depth, text)
    heads = np.searchsorted(text[sorted_small], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if t[n - 1] >= 0 and not small[n - 1]:
        waiting[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = []
        level = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        while len(level):
            front.append(level)
            before = level[level > 0] - 1
            level = before[t[before] == c]
        bucket = np.concatenate([*front, sorted_small[heads[c] : heads[c + 1]]]) if front else sorted_small[heads[c] : heads[c + 1]]
        waiting[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = t[before]
        before, byte = before[byte > c], byte[byte > c].astype(np.uint8)
        if len(before):
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            marks = np.searchsorted(byte, np.arange(257))
            for d in np.flatnonzero(np.diff(marks)).tolist():
                waiting[d].append(before[marks[d] : marks[d + 1]])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """For each neighbour pair of the order, whether ``length`` bytes are common."""
    alive = np.arange(len(order) - 1)
    steps = [*range(0, length - 7, 8)]
    if length % 8:
        steps.append(length - 8)
    for step in steps:
        alive = alive[words[order[alive] + step] == words[order[alive + 1] + step]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[alive] = True
    return out


def judge_bytes(length: int):
    def judge(pieces: list[np.ndarray], docs: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        wins = np.array([len(p) - length + 1 for p in pieces])
        sizes = np.array([len(p) + 1 for p in pieces])
        base = np.concatenate(([0], np.cumsum(sizes)))
        text = np.zeros(base[-1], np.uint8)
        for p, b in zip(pieces, base, strict=False):
            text[b : b + len(p)] = p
        owner = np.repeat(np.arange(len(pieces)), sizes)
        inside = np.arange(len(text)) - base[owner]
        words = _words(text, length + 8)
        order = two_stage(text, length + 4, words, (owner, base[:-1] + wins - 1))
        order = order[(inside < wins[owner])[order]]
        same = common(order, words, length)
        # of each class of equal strings the least place stays
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        place = (docs[owner[order]] << 32) + starts[owner[order]] + inside[order]
        least = np.minimum.reduceat(place, head)
        gone = np.zeros(len(text), bool)
        gone[order[place != np.repeat(least, np.diff(np.concatenate((head, [len(order)]))))]] = True
        return [gone[b : b + w] for b, w in zip(base, wins, strict=False)]

    return judge


def _read(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return BYTE_WORD[data], data


def repeated_bytes(rows: DataFrame, length: int = 100, gram: int = 32) -> DataFrame:
    """(doc_id, nth, runs) of the string starts that also start earlier, for ``numbered`` rows."""
    return recurring_windows(rows, Symbols(_read, gram, length, "uint8", 10), judge_bytes(length))


def byte_digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, runs in zip(pdf["doc_id"], pdf["text"], pdf["runs"], strict=True):
                data = np.frombuffer((text if isinstance(text, str) else "").encode("utf-8"), np.uint8)
                gone = covered(runs, len(data), length)
                spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
                out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = numbered(docs)
    return per_text(rows, repeated_bytes(rows, length), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
