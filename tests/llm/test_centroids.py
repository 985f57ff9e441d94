import hashlib
import math

import numpy as np
import pytest

from perennial.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, size, scale, k, rounds, seed):
    most = centroids.bound(size)
    points = []
    for key, vector, *_ in rows:
        if vector is None or len(vector) != size or any(x is None or not math.isfinite(x) for x in vector):
            continue
        points.append((key, [max(-most, min(most, math.floor(float(scale) * x))) for x in vector]))
    name = lambda p: hashlib.sha256(f"{seed}:{'' if p[0] is None else p[0]}".encode()).hexdigest()
    means = [p for _, p in sorted(points, key=lambda p: (name(p), p[1]))[:k]]

    def nearest(p):
        away = [sum((a - b) ** 2 for a, b in zip(p, c)) for c in means]
        return min(range(len(means)), key=lambda c: (away[c], c)), min(away)

    for _ in range(rounds):
        held = [[] for _ in means]
        for _, p in points:
            held[nearest(p)[0]].append(p)
        means = [[sum(x) // len(h) for x in zip(*h)] if h else c for h, c in zip(held, means)]
    found = [(key, *nearest(p)) for key, p in points]
    sums = [sum(d for _, c, d in found if c == i) for i in range(len(means))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    most = (1 << 63) - 1
    whole = min(most, sum(sums))
    return sorted(((key, c, d, min(most, sums[c]), whole, digest[c]) for key, c, d in found), key=str)


def run(vectors, **options):
    got = centroids.with_inertia(*centroids.cluster_vectors(vectors, **options))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("spread", [3, 40, 100_000])
def test_search_against_all_distances(spread):
    draw = np.random.default_rng(spread)
    for k, size in ((1, 4), (2, 3), (17, 2), (40, 8)):
        means = draw.integers(-spread, spread, (k, size))
        means[k // 2] = means[0]
        points = np.concatenate([means, means + 1, draw.integers(-spread, spread, (5000, size))])
        away = ((points[:, None] - means[None]) ** 2).sum(axis=2)
        number, distance = centroids.Orchard(means).nearest(points)
        assert number.tolist() == away.argmin(axis=1).tolist()
        assert distance.tolist() == away.min(axis=1).tolist()


def test_far_centroids_are_not_measured(monkeypatch):
    means = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    seen = []
    einsum = np.einsum
    monkeypatch.setattr(centroids.np, "einsum", lambda f, a, b: seen.append(len(a)) or einsum(f, a, b))
    centroids.Orchard(means).nearest(np.array([[3, 4], [499, 0]]))
    assert sum(seen) == 2


def clustered(n, size, seed=1):
    draw = np.random.default_rng(seed)
    middle = draw.normal(0, 1, (6, size))
    return [(i, (middle[i % 6] + draw.normal(0, 0.2, size)).tolist(), i % 6) for i in range(n)]


def test_rounds_against_plain_clustering(spark):
    rows = clustered(600, 5)
    rows += [(i, rows[0][1], 0) for i in range(700, 900)] + rows[:30]
    options = {"size": 5, "scale": 16, "k": 9, "rounds": 3, "seed": "x"}
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert run(vectors, **options) == plain(rows, **options)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0), (None, [0.0, -0.1], 0), (None, [3.0, 3.0], None),
        (2, None, 0), (3, [1.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [inf, 0.0], 0), (7, [-inf, 0.0], 0),
        (8, [1.0, 2.0, 3.0], 0), (9, [], 0), (10, [1e300, -1e300], 0), (11, [-1e300, 1e300], 0), (12, [-0.0, 1e-300], 0),
    ]
    vectors = spark.createDataFrame(rows, SCHEMA)
    for name in ("cluster", "distance", "point", "parts"):
        vectors = vectors.selectExpr("*", f"'x' AS {name}")
    for k in (1, 3, 40):
        options = {"size": 2, "scale": 4, "k": k, "rounds": 2, "seed": "2"}
        assert run(vectors, **options) == plain(rows, **options)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 0)]):
        assert run(spark.createDataFrame(rows, SCHEMA)) == []
