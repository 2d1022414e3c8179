"""Repeated windows: split anchors, repeated rows, missing ids, empty tables; all against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docforge.llm import repeats, substring, suffix

SCHEMA = "doc_id long, text string, runs string, _stay long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def brute_bytes(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_words(rows, length):
    texts = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
    seen = Counter(tuple(w[i : i + length]) for _, w in texts for i in range(len(w) - length + 1))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def passages(seed, n=60):
    """Texts of few words, with common passages in ever other contexts, and repeats inside one text."""
    r = random.Random(seed)
    word = lambda: r.choice("ab cd efg hij klmn o pq rst uvé w xyz".split()) + str(r.randint(0, 400))
    common = [" ".join(word() for _ in range(k)) for k in (12, 45, 45, 130)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(" ".join(word() for _ in range(r.randint(0, 30))))
            parts.append(r.choice(common))
        rows.append((i, "  ".join(parts)))
    rows += [(3, rows[3][1]), (3, rows[3][1]), (4, "other " + rows[4][1]), (7, None), (None, rows[5][1]), (None, None), (900, ""), (901, "z" * 700), (902, "ab " * 300)]
    return rows


@pytest.mark.parametrize("names", [256, 1])
def test_bytes_and_words_as_brute_force(spark, monkeypatch, names):
    rows = passages(names)
    whole = repeats.recurring_windows
    for module in (suffix, substring):
        monkeypatch.setattr(module, "recurring_windows", lambda d, sym, judge: whole(d, sym, judge, room=1 << 12, names=names))
    df = frame(spark, rows).repartition(3)
    assert Counter(map(tuple, suffix.byte_digests(df, 100).collect())) == brute_bytes(rows, 100)
    assert Counter(map(tuple, substring.word_digests(df, 35).collect())) == brute_words(rows, 35)


def test_third_places_are_settled_before_the_exchange(spark):
    rows = [(i, "a line that all texts share " * 8) for i in range(40)]
    sym = suffix.Symbols(suffix._read, 32, 100, "uint8", 10)
    got = repeats._anchors(repeats.numbered(frame(spark, rows).coalesce(1)), sym)
    names = got.where("not known").groupBy("a", "b").count().agg(F.max("count")).first()[0]
    assert names == 2 and got.where("known").count() > 38


def test_words_that_share_half_a_hash_stay(spark):
    one, two = [f"x{i}" for i in range(35)], [f"x{i}" for i in range(35)]
    one[17], two[17] = "w130688", "w205530"
    got = substring.word_digests(frame(spark, [(1, " ".join(one)), (2, " ".join(two))])).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_a_row_given_twice_keeps_its_first_copy(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefghij ") for _ in range(370))
    got = suffix.byte_digests(frame(spark, [(1, text), (1, text)])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 370]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffix.byte_digests(none).collect() == [] and substring.word_digests(none).collect() == []


def test_hits_extend_to_the_whole_repeat():
    import numpy as np

    r = np.random.default_rng(3)
    body = r.integers(1, 1 << 60, 80).astype(np.uint64)
    one = np.concatenate((r.integers(1, 1 << 60, 9), body, r.integers(1, 1 << 60, 5))).astype(np.uint64)
    two = np.concatenate((r.integers(1, 1 << 60, 21), body, r.integers(1, 1 << 60, 2))).astype(np.uint64)
    gone = substring.judge_words(35, 18)([one, two], np.array([0, 1]), np.array([0, 0]))
    assert np.flatnonzero(gone[0]).tolist() == list(range(9, 9 + 46)) and np.flatnonzero(gone[1]).tolist() == list(range(21, 21 + 46))
