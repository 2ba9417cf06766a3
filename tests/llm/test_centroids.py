import hashlib

import numpy as np
import pytest

from tarnwatch.llm.centroids import Moves, cluster, distances, scanned, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, q int, cluster string"


def brute(rows, k, rounds, dim, scale=1024, seed=3):
    """All distances in Python integers, every round."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [q for _, q in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min(range(len(centroids)), key=lambda j: (far(q, centroids[j]), j))
    for _ in range(rounds):
        own = [near(q) for _, q in kept]
        for j in range(len(centroids)):
            mine = [q for (_, q), c in zip(kept, own) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((-1 if i is None else i, near(q), far(q, centroids[near(q)])) for i, q in kept), centroids


def clustered(spark, rows, k, rounds, dim):
    out, centroids = cluster(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA), k, rounds, dim)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in out.collect()), centroids.tolist()


def vectors(n, dim, seed, spots=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(spots, dim))
    return [(i, (centre[rng.integers(spots)] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_against_all_distances(spark):
    rows = vectors(400, 6, 1)
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a third are copies
    rows += [(5, rows[9][1]), (5, rows[5][1]), (None, rows[3][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [None] + [0.0] * 5), (2004, [float("nan")] * 6), (2005, [float("inf")] * 6), (2006, [-float("inf")] * 6)]
    for k, rounds in ((5, 10), (3, 4), (1, 3), (4, 0)):
        assert clustered(spark, rows, k, rounds, 6) == brute(rows, k, rounds, 6)


def test_ties_go_to_the_smaller_number(spark):
    # A lattice: most vectors have several nearest centroids.
    rows = [(i, [(i % 5) / 1024, (i // 5 % 5) / 1024]) for i in range(150)]
    for k in (2, 4, 7):
        assert clustered(spark, rows, k, 10, 2) == brute(rows, k, 10, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.25, 0.0])]
    assert clustered(spark, rows, 8, 10, 2) == brute(rows, 8, 10, 2)
    assert clustered(spark, [(1, [0.0])], 8, 10, 2) == ([], [])


def test_too_large_a_component_raises(spark):
    with pytest.raises(Exception, match="after scaling"):
        whole_vectors(spark.createDataFrame([(1, [1e30, 0.0], 1, "x")], SCHEMA), 2).collect()


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(4)
    centre = rng.integers(-2000, 2000, (6, 8))
    q = (centre[rng.integers(6, size=3000)] + rng.integers(-300, 300, (3000, 8))).astype(np.int64)
    before = centre.astype(np.int64)
    own, upper, lower = scanned(q, before)
    total = 0
    for _ in range(6):
        after = before + rng.integers(-20, 20, before.shape)
        own, upper, lower, full = Moves(before, after).assign(q, own, upper, lower)
        d = distances(q, after)
        root = np.sqrt(d)
        assert np.array_equal(own, d.argmin(axis=1))
        assert (upper >= root[np.arange(3000), own]).all() and (lower <= np.partition(root, 1, axis=1)[:, 1]).all()
        total, before = total + full, after
    assert total < 0.2 * 6 * 3000
