"""Vectorised numpy kernels shared by the duplicate operators.

All hashing is 64-bit and pure: the same bytes give the same value in every
worker, so a lost task that is run again emits the same rows.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (xor-shift-multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


#: One pseudo-random word per byte value.
BYTE_WORD = mix64((np.arange(256, dtype=U64) + U64(1)) * U64(_GOLD))
_BASE = (_GOLD * 6 + 1) & _MASK | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), U64(base & _MASK))
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_cache: dict[str, np.ndarray] = {}


def _pow(kind: str, n: int) -> np.ndarray:
    have = _cache.get(kind)
    if have is None or len(have) < n:
        have = _cache[kind] = powers(_BASE if kind == "up" else _BASE_INV, max(n, 1 << 16))
        if n > 1 << 23:  # keep no table for one giant text
            _cache.pop(kind)
    return have[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside [\\x20\\x09-\\x0D]."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    if not gap[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z folded when ``lower``)."""
    if not len(starts):
        return np.empty(0, U64)
    raw = BYTE_WORD[_LOWER[data]] if lower else BYTE_WORD[data]
    acc = np.empty(len(data) + 1, U64)
    acc[0] = 0
    np.cumsum(raw * _pow("up", len(data)), out=acc[1:])
    h = (acc[ends] - acc[starts]) * _pow("down", len(data))[starts]
    return mix64(h + (ends - starts).astype(U64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive symbols of one sequence."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    acc = np.empty(len(h) + 1, U64)
    acc[0] = 0
    np.cumsum(h * _pow("up", len(h)), out=acc[1:])
    return mix64((acc[n:] - acc[:-n]) * _pow("down", m))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each window of w entries, by doubling."""
    cur, span = x, 1
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if span < w:
        cur = np.minimum(cur[: len(cur) - (w - span)], cur[w - span :])
    return cur


def winnow(sym: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one sequence: the least gram hash of every window.

    A window is ``window`` symbols, so it holds ``window - gram + 1`` grams.
    Returns (anchor position, anchor hash, first window, last window): the
    windows, a contiguous range of starts, whose least gram this anchor is
    (the leftmost on ties).  Equal windows always pick the same gram at the
    same place, wherever they stand.  Long sequences go block by block, so a
    position fits the low bits of the compared key.
    """
    g = gram_hashes(sym, gram)
    w = window - gram + 1
    n_win = len(g) - w + 1
    if n_win <= 0:
        e = np.empty(0, np.int64)
        return e, np.empty(0, U64), e, e
    bits = 18
    low, step = U64((1 << bits) - 1), (1 << bits) - w
    place = np.arange(1 << bits, dtype=U64)
    pos = np.empty(n_win, np.int64)
    for at in range(0, n_win, step):
        part = g[at : min(at + step, n_win) + w - 1]
        best = window_min((part & ~low) | place[: len(part)], w)
        pos[at : at + len(best)] = (best & low).astype(np.int64) + at
    first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
    last = np.concatenate((first[1:], [n_win])) - 1
    at = pos[first]
    return at, g[at], first, last
