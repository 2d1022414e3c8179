"""Where windows of a fixed number of symbols recur, over whole corpora.

Shared by the byte and the word operator.  Each text names, for every window,
one anchor: the least hash of the grams inside.  Equal windows name equal
anchors, so a window whose anchor hash stands nowhere else cannot recur, and the
windows of the others form one short piece an anchor.  A piece has a name, the
128-bit digest of its symbols and of the anchor's place in it.

What recurs is judged on symbols, by the operator's own method: of every name,
the first two places are asked for; all places of one anchor hash meet, and
neighbouring pieces of a text that meet in one place travel as one segment.
Only the third and further places of a name are settled by it: of copies that
equal one that was judged, none is the first.  They are so settled already where
texts are read, so a passage that all texts share leaves each task as two rows.
An anchor hash with more than ``names`` contexts is split: its windows then meet
one by one, by their own digests, with the same pre-aggregation.

Rows that repeat a doc_id are told apart by their rank in the order of texts
(equal rows: in any order); a missing doc_id comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docforge.llm.common import cut
from docforge.llm.kernels import mix64, winnow

U64 = np.uint64
ANCHOR = "h long, a long, b long, doc_id long, nth long, place long, known boolean"
FOUND = "doc_id long, nth long, lo int, hi int, key long, way int"
PIECE = "key long, doc_id long, nth long, start int, hi int, body binary"
RUNS = "doc_id long, nth long, lo int, hi int"
#: How a piece goes on: it is known to go, it is judged with its anchor's pieces, its windows are judged one by one.
KNOWN, JUDGED, APART = 0, 1, 2
#: Stands for a missing doc_id.
NO_ID = -(1 << 63)


class Symbols:
    """How a text becomes symbols: ``read`` gives what to hash and what to move, of one length.

    A window holds fewer than 2**16 grams, so a place packs into 64 bits.
    Anchors that stand first in one stretch of 2**``reach`` symbols meet in one
    place, so that neighbours travel together.
    """

    def __init__(self, read: Callable[[str], tuple[np.ndarray, np.ndarray]], gram: int, window: int, dtype: str, reach: int):
        assert window - gram + 1 < 1 << 16
        self.read, self.gram, self.window, self.dtype, self.reach = read, gram, window, dtype, reach


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, nth): rows that repeat a doc_id get a rank, all others 0."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    twice = own.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return own.withColumn("nth", F.lit(0).cast("long"))
    twice = cut(twice)
    once = own.join(twice, "doc_id", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1
    return once.unionByName(cut(own.join(twice, "doc_id", "left_semi").withColumn("nth", rank.cast("long"))))


def _spare(names: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """Which rows are not among the two least (by ``order``) of their name."""
    by = np.argsort(names[0], kind="stable")
    first = names[0][by]
    new = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    sizes = np.diff(np.concatenate((new, [len(by)])))
    many = by[np.repeat(sizes > 2, sizes)]
    out = np.zeros(len(by), bool)
    if len(many):
        rank = np.lexsort([x[many] for x in reversed([*names, *order])])
        many = many[rank]
        head = np.zeros(len(many), bool)
        head[0] = True
        for x in names:
            head[1:] |= x[many][1:] != x[many][:-1]
        at = np.arange(len(many))
        out[many[at - np.maximum.accumulate(np.where(head, at, 0)) >= 2]] = True
    return out


def _anchors(docs: DataFrame, sym: Symbols, room: int = 400_000) -> DataFrame:
    """A row an anchor; ``place`` packs the first window and the number of windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0

        def close() -> pd.DataFrame:
            h, a, b, doc, nth, place = (np.concatenate(c) for c in zip(*rows, strict=True))
            known = _spare([a, b], [doc, nth, place])
            # what is known takes any way through the exchange
            h[known] = mix64(doc[known].astype(U64) ^ place[known].astype(U64)).view(np.int64)
            return pd.DataFrame({"h": h, "a": a, "b": b, "doc_id": doc, "nth": nth, "place": place, "known": known})

        for pdf in batches:
            for doc, nth, text in zip(pdf["doc_id"], pdf["nth"], pdf["text"], strict=True):
                if not isinstance(text, str):
                    continue
                keys, body = sym.read(text)
                at, h, first, last = winnow(keys, sym.gram, sym.window)
                if not len(at):
                    continue
                raw, size, tail = body.tobytes(), body.itemsize, sym.window
                digest = hashlib.blake2b
                names = b"".join([
                    digest(raw[f * size : (z + tail) * size], digest_size=16, salt=(p - f).to_bytes(4, "little")).digest()
                    for f, z, p in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)
                ])
                name = np.frombuffer(names, np.int64).reshape(-1, 2)
                n = len(at)
                rows.append((h.view(np.int64), name[:, 0], name[:, 1], np.full(n, doc, np.int64), np.full(n, nth, np.int64), first.astype(np.int64) << 16 | (last - first + 1)))
                held += n
                if held >= room:
                    yield close()
                    rows, held = [], 0
        if rows:
            yield close()

    return docs.select("doc_id", "nth", "text").mapInPandas(run, ANCHOR)


def _sift(names: int, reach: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by (h, a, b, doc_id, nth, place) to what becomes of their pieces.

    Held between batches: the rows of the last h, two a name; of an h with more
    than ``names`` names, only its last name.
    """

    def found(rows: np.ndarray, way, key=0) -> pd.DataFrame:
        lo = rows[:, 5] >> 16
        return pd.DataFrame({"doc_id": rows[:, 3], "nth": rows[:, 4], "lo": lo.astype(np.int32), "hi": (lo + (rows[:, 5] & 65535) - 1).astype(np.int32), "key": key, "way": way})

    def settle(rows: np.ndarray) -> pd.DataFrame:
        """Whole anchor hashes; a piece whose anchor stands nowhere else is out."""
        new = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        sizes = np.diff(np.concatenate((new, [len(rows)])))
        # all go where the first of them stands, in the order of texts
        doc = np.minimum.reduceat(rows[:, 3], new)
        there = rows[:, 3] == np.repeat(doc, sizes)
        place = np.minimum.reduceat(np.where(there, (rows[:, 4] << 40) + (rows[:, 5] >> (16 + reach)), np.iinfo(np.int64).max), new)
        key = mix64(doc.astype(U64) * U64(0x9E3779B97F4A7C15) ^ mix64(place.astype(U64)))
        more = np.repeat(sizes > 1, sizes)
        way = np.repeat(np.where(sizes > 2 * names, APART, JUDGED), sizes)
        return found(rows[more], way[more], np.repeat(key.view(np.int64), sizes)[more])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, apart, gone = np.empty((0, 6), np.int64), None, 0
        for pdf in batches:
            known = pdf["known"].to_numpy(bool)
            rows = pdf[["h", "a", "b", "doc_id", "nth", "place"]].to_numpy()
            if known.any():
                yield found(rows[known], KNOWN)
                rows = rows[~known]
            if not len(rows):
                continue
            rows = np.concatenate((held, rows))
            head = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(1)))
            at = np.arange(len(rows))
            third = at - np.maximum.accumulate(np.where(head, at, 0)) >= 2
            if third.any():
                yield found(rows[third], KNOWN)
                rows = rows[~third]
            if apart is not None:  # the first ``gone`` rows are on their way
                mine = int(np.searchsorted(rows[:, 0] != apart, True)) if rows[-1, 0] != apart else len(rows)
                if mine > gone:
                    yield found(rows[gone:mine], APART)
                if mine == len(rows):
                    held = rows[-2:] if (rows[-2:, :3] == rows[-1, :3]).all() else rows[-1:]
                    gone = len(held)
                    continue
                rows, apart, gone = rows[mine:], None, 0
            last = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1 if rows[0, 0] != rows[-1, 0] else 0
            if last:
                yield settle(rows[:last])
            held = rows[last:]
            if len(held) > 2 * names:
                yield found(held, APART)
                apart = held[-1, 0]
                held = held[-2:] if (held[-2:, :3] == held[-1, :3]).all() else held[-1:]
                gone = len(held)
        if len(held) and apart is None:
            yield settle(held)

    return run


def _pieces(docs: DataFrame, asked: DataFrame, sym: Symbols) -> DataFrame:
    """The segments asked for, with their symbols; a row without them is known to go."""

    def frame(rows: list[tuple], apart: list[tuple]) -> pd.DataFrame:
        apart.sort()
        for i, (name, doc, nth, s, raw) in enumerate(apart):
            known = i > 1 and apart[i - 2][0] == name
            rows.append((int.from_bytes(name[:8], "little", signed=True), doc, nth, s, s, None if known else raw))
        return pd.DataFrame(rows, columns=["key", "doc_id", "nth", "start", "hi", "body"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, apart = [], []
            for doc, nth, text, wanted in zip(pdf["doc_id"], pdf["nth"], pdf["text"], pdf["at"], strict=True):
                body = sym.read(text)[1]
                end, piece = None, None
                for lo, hi, key, way in sorted((w["lo"], w["hi"], w["key"], w["way"]) for w in wanted):
                    if way == APART:
                        for s in range(lo, hi + 1):
                            raw = body[s : s + sym.window].tobytes()
                            apart.append((hashlib.blake2b(raw, digest_size=16).digest(), doc, nth, s, raw))
                    elif end is not None and piece[0] == key and lo == end + 1:
                        end = hi
                    else:
                        if piece:
                            rows.append((piece[0], doc, nth, piece[1], 0, body[piece[1] : end + sym.window].tobytes()))
                        piece, end = (key, lo), hi
                if piece:
                    rows.append((piece[0], doc, nth, piece[1], 0, body[piece[1] : end + sym.window].tobytes()))
                if len(apart) + len(rows) > 20_000:
                    yield frame(rows, apart)
                    rows, apart = [], []
            if rows or apart:
                yield frame(rows, apart)

    return docs.where("text is not null").join(asked, ["doc_id", "nth"]).mapInPandas(run, PIECE)


#: judge(segments, texts' ranks, starts) -> for each segment a boolean array: which of its windows go
Judge = Callable[[list[np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]]


def _meet(sym: Symbols, judge: Judge, room: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by key to the runs of windows that go; whole groups are judged some ``room`` bytes at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, int, bytes]] = []
        known: list[tuple[int, int, int, int]] = []
        size, now, alone, one = 0, None, 0, np.dtype(sym.dtype).itemsize * sym.window

        def settle() -> pd.DataFrame:
            nonlocal held, known, size
            out, known = known, []
            if held:
                # texts by rank, so that one number orders them
                texts = {t: i for i, t in enumerate(sorted({p[:2] for p in held}))}
                gone = judge([np.frombuffer(p[3], sym.dtype) for p in held], np.array([texts[p[:2]] for p in held], np.int64), np.array([p[2] for p in held], np.int64))
                for (doc, nth, start, _), mask in zip(held, gone, strict=True):
                    if mask.any():
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                        out.extend((doc, nth, start + int(a), start + int(z) - 1) for a, z in zip(edge[::2], edge[1::2], strict=True))
            held, size = [], 0
            return pd.DataFrame(out, columns=["doc_id", "nth", "lo", "hi"])

        # ``alone``: how many are held if the present key has but one
        for pdf in batches:
            for key, doc, nth, start, hi, body in zip(*(pdf[c].tolist() for c in ("key", "doc_id", "nth", "start", "hi", "body")), strict=True):
                if key != now:
                    if held and len(held) == alone and len(held[-1][3]) == one:  # a window that met no other
                        size -= len(held.pop()[3])
                    now, alone = key, len(held) + 1
                    if size > room or len(known) > 50_000:
                        yield settle()
                        alone = 1
                if body is None:
                    known.append((doc, nth, start, hi))
                else:
                    held.append((doc, nth, start, body))
                    size += len(body)
        yield settle()

    return run


def recurring_windows(rows: DataFrame, sym: Symbols, judge: Judge, room: int = 4 << 20, names: int = 1024) -> DataFrame:
    """(doc_id, nth, runs: array of (lo, hi)) of the window starts that go, for ``numbered`` rows."""
    anchors = _anchors(rows, sym).repartition("h").sortWithinPartitions("h", "a", "b", "doc_id", "nth", "place")
    found = cut(anchors.mapInPandas(_sift(names, sym.reach), FOUND))
    asked = found.where(F.col("way") != KNOWN).groupBy("doc_id", "nth").agg(F.collect_list(F.struct("lo", "hi", "key", "way")).alias("at"))
    met = _pieces(rows, asked, sym).repartition("key").sortWithinPartitions("key").mapInPandas(_meet(sym, judge, room), RUNS)
    runs = found.where(F.col("way") == KNOWN).select("doc_id", "nth", "lo", "hi").unionByName(cut(met))
    return runs.groupBy("doc_id", "nth").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def per_text(rows: DataFrame, runs: DataFrame, make, schema: str) -> DataFrame:
    """``make`` (batches with doc_id, text and runs) over the ``numbered`` rows; ``schema`` begins with doc_id."""
    out = rows.join(runs, ["doc_id", "nth"], "left").select("doc_id", "text", "runs").mapInPandas(make, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def covered(runs, n: int, window: int) -> np.ndarray:
    """Which of n symbols a reported window covers."""
    step = np.zeros(n + 1, np.int32)
    if runs is not None and len(runs):
        lo = np.array([r["lo"] for r in runs], np.int64)
        hi = np.array([r["hi"] for r in runs], np.int64) + window
        np.add.at(step, lo, 1)
        np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0
