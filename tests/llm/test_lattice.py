"""op12 and op13 against plain Lloyd rounds in Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from docforge.llm import centroids, codes, lattice


def whole(values, scale):
    return [math.floor(Fraction(float(np.float64(v))) * scale) for v in values]


def stored(x):
    return b"".join(v.to_bytes(4, "little", signed=True) for v in x) if max(map(abs, x), default=0) < 1 << 31 else x


def far(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))


def lloyd(points, book, rounds):
    """(entry and squared distance of each point, final book)"""
    pick = lambda x: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        near = [pick(x)[1] for x in points]
        moved = []
        for e, c in enumerate(book):
            own = [x for x, n in zip(points, near, strict=True) if n == e]
            moved.append([sum(col) // len(own) for col in zip(*own, strict=True)] if own else c)
        book = moved
    return [pick(x)[::-1] for x in points], book


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_centroids(rows, k=16, rounds=3, size=64, scale=64):
    kept = [(i, whole(v, scale)) for i, v, _ in rows if finite(v) and len(v) == size]
    starts = [x for _, _, x in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), stored(x), x) for i, x in kept if i is not None)[:k]]
    near, book = lloyd([x for _, x in kept], starts, rounds)
    of = {c: sum(d for e, d in near if e == c) for c in {e for e, _ in near}}
    fit = lambda v: v if v < 1 << 63 else None
    lost = any(fit(d) is None for _, d in near)
    bad = {e for e, d in near if fit(d) is None}
    return sorted(
        ((i, e, fit(d), None if e in bad else fit(of[e]), None if lost else fit(sum(of.values())), hashlib.sha256(",".join(map(str, book[e])).encode()).hexdigest()) for (i, _), (e, d) in zip(kept, near, strict=True)), key=repr
    )


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, whole(v, scale), label) for i, v, label in rows if finite(v)]
    order = [(i, x) for i, _, _, x in sorted((i, len(x), stored(x), x) for i, x, _ in kept if i is not None)]
    size = len(order[0][1])
    fit = [k for k in kept if len(k[1]) == size]
    w = size // parts
    near, books = [], []
    for p in range(parts):
        cut = lambda x, p=p: x[p * w : (p + 1) * w]
        starts = [cut(x) for _, x in order if len(x) == size][:entries]
        got, book = lloyd([cut(x) for _, x, _ in fit], starts, rounds)
        near.append(got)
        books.append(book)
    coded = {n: ("".join(f"{near[p][n][0]:02x}" for p in range(parts)), sum(near[p][n][1] for p in range(parts))) for n in range(len(fit))}
    rows_ = [(i, label, *coded[n]) for n, (i, _, label) in enumerate(fit)] + [(i, label, None, None) for i, x, label in kept if len(x) != size]
    sums = {}
    for _, label, _, e in rows_:
        sums[label] = sums.get(label, 0) + (e or 0)
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest) for i, label, c, e in rows_), key=repr)


def some(rng, n, size, spread=1.0, near=40):
    centre = rng.normal(size=(near, size))
    return [[float(np.float32(x)) for x in (centre[rng.integers(near)] + rng.normal(size=size) * 0.2) * spread] for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def odd_rows(size):
    rng = np.random.default_rng(4)
    v = some(rng, 60, size)
    rows = [(i, x, int(i % 3)) for i, x in enumerate(v)]
    rows += [(7, v[7], 1), (7, v[7], 1), (8, v[20], None), (None, v[3], 2), (None, None, 2)]
    rows += [(200, [*v[1][:-1], None], 1), (201, [*v[1][:-1], math.nan], 1), (202, [*v[1][:-1], -math.inf], 1), (203, None, 1), (204, [0.0] * size, None), (205, [-0.0] * size, None), (206, [-1e-9] * size, 1)]
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_centroids_with_odd_rows(spark):
    rows = odd_rows(64) + [(300, [1.0] * 63, 1), (301, [], 1)]
    assert got(centroids.cluster_vectors(table(spark, rows))) == brute_centroids(rows)


def test_centroids_fewer_than_k_ties_and_empty(spark):
    rows = [(i, [float(i % 2)] * 64, None) for i in range(6)]
    assert got(centroids.cluster_vectors(table(spark, rows))) == brute_centroids(rows)
    empty = centroids.cluster_vectors(table(spark, rows).where("false"))
    assert (empty.columns, empty.count()) == (["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"], 0)
    assert centroids.cluster_vectors(table(spark, [(None, [1.0] * 64, 1)])).count() == 0


@pytest.mark.parametrize("top", [3.0, 1e9, 1.7e308])
def test_wide_components_stay_exact(spark, top):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) * top for x in rng.uniform(-1, 1, 64) * (1 if i % 2 else 1e-3)], i % 2) for i in range(24)]
    vectors = table(spark, rows).selectExpr("*", "1 x", "'a' state", "2 size")
    assert got(centroids.cluster_vectors(vectors, k=5)) == brute_centroids(rows, k=5)
    want = [(i, c, e if e is not None and e < 1 << 63 else None, d) for i, c, e, _, d in brute_codes(rows, entries=9)]
    assert [(r[0], r[1], r[2], r[4]) for r in got(codes.compress(vectors, entries=9, groups=3))] == want


def test_codes_with_odd_rows(spark):
    rows = odd_rows(16) + [(300, [1.0] * 15, 1), (301, [], 2), (302, [1.0] * 20, None)]
    assert got(codes.compress(table(spark, rows), entries=16, groups=4)) == brute_codes(rows, entries=16)


def test_codes_by_many_labels_and_empty(spark, monkeypatch):
    monkeypatch.setattr(codes, "LABELS", 1)
    rows = odd_rows(16)
    assert got(codes.compress(table(spark, rows), entries=16, groups=4)) == brute_codes(rows, entries=16)
    assert codes.compress(table(spark, rows).where("false")).count() == 0
    five = codes.compress(table(spark, [(1, [1.0] * 5, 1)])).first()
    assert (five["code"], five["error"], five["label_error"]) == (None, None, 0)


def test_bounds_spare_groups_and_keep_every_tie(spark):
    rng = np.random.default_rng(2)
    v = some(rng, 1500, 16, near=200)
    rows = [(i, x, 1) for i, x in enumerate(v)] + [(2000 + i, v[i], 1) for i in range(60)]
    scans = []
    assert got(codes.compress(table(spark, rows), entries=64, groups=12, scans=scans)) == brute_codes(rows, entries=64)
    full = len(rows) * 4 * 64
    assert scans[0] == full
    assert all(s < full * 0.6 for s in scans[1:]) and scans[-1] < full * 0.4


def test_sums_in_digits():
    own = lattice.Sums(3, 2)
    x = np.array([[1 << 50, -5], [-(1 << 50), 7], [3, -(1 << 45)], [1 << 200, 1]], object)
    own.add(x, np.array([0, 2, 0, 2]))
    total = {}
    for _, e, digit, n, s in own.rows(0):
        have = total.setdefault(e, [0, 0, 0])
        have[0] += n
        have[1] += s[0] << lattice.DIGIT * digit
        have[2] += s[1] << lattice.DIGIT * digit
    assert total == {0: [2, (1 << 50) + 3, -5 - (1 << 45)], 2: [2, (1 << 200) - (1 << 50), 8]}
