"""Delta Lloyd against plain Lloyd."""

import hashlib
import math

import numpy as np
import pytest

from orfweave.llm import clustering

SCHEMA = "vec_id bigint, embedding array<float>, Cluster int, distance double, id string"


def lloyd(rows, k, rounds, size, scale=256):
    """(id, x) to (id, cluster, distance) and centroids, whole numbers throughout."""
    kept = [(i, [math.floor(scale * float(np.float32(e))) for e in v]) for i, v in rows if v is not None and len(v) == size and all(e is not None and math.isfinite(e) for e in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        new = []
        for j, c in enumerate(centroids):
            members = [x for (_, x), o in zip(kept, own) if o == j]
            new.append([sum(col) // len(members) for col in zip(*members)] if members else c)
        centroids = new
    return [(i, near(x)[1], near(x)[0]) for i, x in kept], centroids


def vectors(n, size, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (6, size))
    rows = [(k, [float(np.float32(e)) for e in middle[k % 6] + rng.normal(0, 0.6, size)]) for k in range(n)]
    bad = [(n, None), (n + 1, []), (n + 2, rows[0][1][:-1]), (n + 3, [None, *rows[0][1][1:]]), (n + 4, [float("nan"), *rows[0][1][1:]]), (n + 5, [float("-inf"), *rows[0][1][1:]])]
    return rows + bad + rows[:5] + [(None, rows[7][1]), (3, rows[9][1]), (n + 6, [0.0] * size)]


@pytest.mark.parametrize("k, rounds", [(9, 5), (1, 2), (500, 1)])
def test_lloyd(spark, k, rounds):
    rows = vectors(150, 5)
    frame = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], SCHEMA).repartition(4)
    want, centroids = lloyd(rows, k, rounds, 5)
    got = clustering.cluster(frame, k, rounds, size=5).collect()
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    assert {tuple(r.centroid) for r in got} <= {tuple(c) for c in centroids}
    assert all(r.centroid == centroids[r.cluster] for r in got)
    assert {r.inertia for r in got} == {sum(d for *_, d in want)}
    assert {(r.cluster, r.cluster_inertia) for r in got} == {(c, sum(d for _, o, d in want if o == c)) for _, c, _ in want}


def test_few(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert clustering.cluster(empty).count() == 0
    one = spark.createDataFrame([(1, [0.5] * 64, 0, 0.0, "")], SCHEMA)
    assert [(r.cluster, r.distance) for r in clustering.cluster(one).collect()] == [(0, 0)]
    with pytest.raises(Exception, match="can't be clustered"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 64, 0, 0.0, "")], SCHEMA)).count()


def test_compare_takes_what_changed():
    rng = np.random.default_rng(0)
    x, centroids = rng.integers(-300, 300, (500, 8)), rng.integers(-300, 300, (12, 8))
    none = np.full(500, -1)
    cluster, distance, pairs = clustering.compare(x, none, np.zeros(500, np.int64), centroids, np.ones(12, bool))
    assert pairs == 500 * 12
    changed = np.zeros(12, bool)
    changed[[2, 7]] = True
    centroids[[2, 7]] += rng.integers(-50, 50, (2, 8))
    moved = np.isin(cluster, [2, 7]).sum()
    again, far, pairs = clustering.compare(x, cluster, distance, centroids, changed)
    assert pairs == moved * 12 + (500 - moved) * 2
    want, least, _ = clustering.compare(x, none, np.zeros(500, np.int64), centroids, np.ones(12, bool))
    assert (again == want).all() and (far == least).all()
    # numbers that doubles don't hold
    big = rng.integers(-(1 << 26), 1 << 26, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in big] for p in big]
    assert clustering.distances(big, big).tolist() == want
