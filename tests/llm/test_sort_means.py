"""Sort-means against plain k-means in Python integers."""

import hashlib
import random

import numpy as np
from oracle import DATA, connect, differences

from bulletin.llm import sort_means


def brute(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = {i: hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~" for i, _ in kept}
    centroids = [v for _, v in sorted(kept, key=lambda r: (key[r[0]], r[1]))[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        for n, g in groups.items():
            centroids[n] = [sum(x) // len(g) for x in zip(*g)]
    rows = [(i, *best(v)) for i, v in kept]
    of = {n: sum(d for _, d, m in rows if m == n) for _, _, n in rows}
    sha = {n: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for n, c in enumerate(centroids)}
    return sorted((str(i), n, d, of[n], sum(of.values()), sha[n]) for i, d, n in rows)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "l", 7, 8) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int, v int")


def got(spark, rows, **options):
    return sorted((str(r[0]), *r[1:]) for r in sort_means.cluster(table(spark, rows), **options).collect())


def test_clusters_with_odd_rows(spark):
    rng = random.Random(2)
    spots = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(spots)]) for i in range(150)]
    odd = [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan")] * 4), (205, [0.0, float("-inf"), 0.0, 0.0]), (3, rows[3][1]), (4, [0.5] * 4), (None, [0.25] * 4)]
    rows += odd
    for k, rounds in ((8, 3), (1, 2), (400, 1), (8, 0)):
        assert got(spark, rows, k=k, rounds=rounds, dims=4) == brute(rows, k, rounds, 4)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 3 - 1), 0.0]) for i in range(30)] + [(50 + i, [0.5, 0.0]) for i in range(4)]
    assert got(spark, rows, k=5, rounds=4, dims=2) == brute(rows, 5, 4, 2)


def test_empty(spark):
    assert got(spark, []) == got(spark, [(1, [0.0])]) == []


def test_scan_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-900, 900, (30, 8))
    points = centroids[rng.integers(0, 30, 2000)] + rng.integers(-40, 40, (2000, 8))
    every = ((points[:, None] - centroids) ** 2).sum(2)
    before = every.argmin(1)
    before[::10] = rng.integers(0, 30, 200)
    for scale in (1, 1 << 13):  # in doubles, in integers
        clusters, found, taken = sort_means.nearest(points * scale, before, centroids * scale)
        assert (clusters == every.argmin(1)).all() and (found == every.min(1) * scale * scale).all() and taken < 0.3 * every.size


def test_query_equals_sql(spark):
    assert differences(sort_means.op13(spark, f"{DATA}/sf0.001"), connect(f"{DATA}/sf0.001"), sort_means.ORACLE) == []
