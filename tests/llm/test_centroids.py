"""Clustering against plain numpy and exact integers."""

import hashlib
import itertools

import numpy as np

from graphfacts.llm import centroids


def plain(rows, k=40, rounds=5):
    """``{(vec_id, ...)}`` by comparing every vector with every centroid."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [q for _, q in sorted(kept, key=key)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        centres = [[sum(col) // len(own[n]) for col in zip(*own[n])] if n in own else c for n, c in enumerate(centres)]
    found = [(i, *near(q)) for i, q in kept]
    each = {}
    for _, d, n in found:
        each[n] = each.get(n, 0) + d
    return [(i, n, d, each[n], sum(each.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in found]


def check(spark, rows):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, distance string")
    got = centroids.clusters(table).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]), key=repr)


def test_clusters_equal_plain_comparison(spark):
    rnd = np.random.default_rng(4)
    centre = rnd.normal(0, 3, (6, 64))
    rows = [(i, (centre[i % 6] + rnd.normal(0, 0.2, 64)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # one vector over and over
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (None, rows[4][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [nan] + [1.0] * 63), (2004, [inf] + [1.0] * 63), (2005, [None] + [1.0] * 63), (2006, [0.0] * 64), (2007, [-1e4] * 64)]
    check(spark, rows)


def test_few_vectors(spark):
    check(spark, [(3, [0.5] * 64), (1, [-0.5] * 64), (2, [0.5] * 64)])
    check(spark, [(1, [1.0] * 3)])
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.clusters(table).collect() == []


def test_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        order = cells[np.argsort(centroids.hilbert(cells, bits))]
        assert sorted(centroids.hilbert(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_boxes_leave_every_nearest_centroid():
    rnd = np.random.default_rng(9)
    passed_over = 0
    for _ in range(200):
        centre = rnd.integers(-300, 300, (12, 5))
        low = rnd.integers(-300, 300, 5)
        high = low + rnd.integers(0, 120, 5)
        inside = rnd.integers(low, high + 1, (200, 5))
        left = centroids.candidates(low, high, centre)
        passed_over += 12 - len(left)
        distances = ((inside[:, None] - centre[None]) ** 2).sum(2)
        which, distance = centroids.nearest(inside, low, high, centre)
        assert (distance == distances.min(1)).all() and (which == distances.argmin(1)).all()
    assert passed_over > 500


def test_large_components_stay_exact():
    big = np.array([[1 << 26, -(1 << 26)], [3, 4]])
    which, distance = centroids.nearest(big, big.min(0), big.max(0), np.array([[-(1 << 26), 1 << 26], [3, 5]]))
    assert list(which) == [1, 1] and list(distance) == [((1 << 26) - 3) ** 2 + ((1 << 26) + 5) ** 2, 1]
