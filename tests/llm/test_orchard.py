"""Orchard search against plain comparison, and its stated edge cases."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from estatelens.llm import orchard


@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 4), st.sampled_from([2, 40, 1 << 61]))
@settings(max_examples=120, deadline=None)
def test_search_equals_plain_comparison(seed, k, width, most):
    rng = random.Random(seed)
    point = lambda: tuple(rng.randint(-most, most) for _ in range(width))
    centroids, points = [point() for _ in range(k)], [point() for _ in range(50)]
    near = orchard.Neighbours(centroids)
    now, best, measured = near.nearest(orchard.fitting(np.array(points, dtype=np.int64)))
    gaps = [[sum((x - y) ** 2 for x, y in zip(p, c, strict=True)) for c in centroids] for p in points]
    assert [(int(b), int(n)) for b, n in zip(best, now, strict=True)] == [min((g, c) for c, g in enumerate(own)) for own in gaps]
    assert measured <= 50 * k


def test_search_leaves_far_centroids_out():
    rng = np.random.default_rng(1)
    centroids = [tuple(int(x) for x in row) for row in rng.integers(-9000, 9000, (64, 3))]
    points = np.array(centroids)[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 3))
    _, _, measured = orchard.Neighbours(centroids).nearest(points)
    assert measured < 2000 * 32


def by_hand(rows, k, rounds, width, scale):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            if members := [v for (_, v), o in zip(kept, own, strict=True) if o == c]:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    told = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in told if c == n) for n in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for i, c, d in told), key=repr)


KIND = "vec_id long, embedding array<float>, cluster int, distance long, place int, total long"


def test_clusters_equal_rounds_by_hand(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), (rng.normal(size=6) + (k % 3) * 4).astype(np.float32).tolist()) for k in range(200)]
    rows += [(500 + k, rows[3][1]) for k in range(120)] + [rows[5]] * 3  # copies, repeated rows
    rows += [(None, rows[9][1]), (900, None), (901, []), (902, [1.0] * 5), (903, [float("nan")] + [0.0] * 5), (904, [None] + [0.0] * 5), (905, [float("inf")] + [0.0] * 5), (906, [0.0] * 6)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], KIND).repartition(5)
    got = sorted((tuple(r) for r in orchard.clusters(docs, k=4, rounds=3, width=6).collect()), key=repr)
    assert got == by_hand(rows, 4, 3, 6, 1024)


def test_very_large_components_and_few_vectors(spark):
    rows = [(1, [1e6, 0.0]), (2, [-1e6, 3.0]), (3, [1e6, 1.0])]
    got = sorted((tuple(r) for r in orchard.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=8, rounds=2, width=2).collect()), key=repr)
    assert got == by_hand(rows, 8, 2, 2, 1024)
    huge = spark.createDataFrame([(k, [3e38 * (-1) ** k, 1.0]) for k in range(9)] + [(9, [0.0, 0.0])], "vec_id long, embedding array<float>")
    told = orchard.clusters(huge, k=2, rounds=0, width=2).collect()
    assert len(told) == 10 and {r["distance"] for r in told} <= {0, None} and all(r["cluster"] in (0, 1) for r in told)


def test_no_vectors(spark):
    assert orchard.clusters(spark.createDataFrame([], KIND)).collect() == []
    assert orchard.clusters(spark.createDataFrame([(1, [1.0] * 63)], "vec_id long, embedding array<float>")).collect() == []
