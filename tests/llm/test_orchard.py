import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlake.llm.orchard import cluster, nearest, neighbour_lists

VECTORS = "vec_id long, embedding array<float>"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k, rounds, dims):
    """Plain clustering with Python's whole numbers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:k]
    centroids = [q for _, q in seeds]

    def assign():
        out = []
        for _, q in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            own = [q for (_, q), (_, c) in zip(kept, near) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    sums = {n: sum(d for d, c in near if c == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums.values()), digest[c]) for (i, _), (d, c) in zip(kept, near)), key=str)


def spark_rows(spark, rows, **how):
    frame = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, VECTORS)
    return sorted([tuple(r[c] for c in COLUMNS) for r in cluster(frame, **how).collect()], key=str)


def test_equal_to_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(i % 5, 0.4) for _ in range(6)]) for i in range(300)]
    assert spark_rows(spark, rows, k=8, rounds=10, dims=6) == brute(rows, 8, 10, 6)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [0.0, -0.0]), (8, [-0.5, 0.5]), (8, [-0.5, 0.5]),
            (None, [0.25, 0.25]), (None, [0.75, 0.25]), (10, [1e-7, -1e-7]), (11, [3.0, 4.0, 5.0])]
    rows += [(100 + i, [0.5, 0.5]) for i in range(30)]
    for k in (1, 3, 8):
        assert spark_rows(spark, rows, k=k, rounds=4, dims=2) == brute(rows, k, 4, 2)
    assert spark_rows(spark, [], k=3, dims=2) == [] and spark_rows(spark, rows[:6], k=3, dims=2) == []
    clash = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("q", "v", "cluster", "distance", "place")})
    assert spark_rows(spark, clash, k=3, rounds=4, dims=2) == brute(rows, 3, 4, 2)
    with pytest.raises(Exception, match="beyond"):
        spark_rows(spark, [(1, [1e30, 0.0])], k=1, dims=2)


def test_search_finds_the_nearest_and_compares_less():
    rng = np.random.default_rng(4)
    centres = rng.integers(-10_000, 10_000, (40, 3))
    points = centres[rng.integers(0, 40, 5_000)] + rng.integers(-300, 300, (5_000, 3))
    compared = []
    number, distance = nearest(points, centres, *neighbour_lists(centres), compared)
    every = ((points[:, None, :] - centres[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert compared[0] < 0.7 * every.size


def test_ties_go_to_the_smaller_number():
    centres = np.array([[4, 0], [0, 0], [0, 0], [-4, 0], [2, 2]])
    points = np.array([[2, 0], [0, 0], [-2, 0], [-4, 0], [1, 1], [4, 0]])
    number, _ = nearest(points, centres, *neighbour_lists(centres))
    assert number.tolist() == ((points[:, None, :] - centres[None]) ** 2).sum(2).argmin(1).tolist()
