"""Clustering by lookup tables against plain Python numbers, and odd input."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import lookup_kmeans

KIND = "vec_id bigint, embedding array<double>, cluster string, distance int, q string"


def by_hand(rows, k, rounds, size):
    """Sorted (vec_id, cluster, distance), inertia by cluster, and centroids."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(max(-2.0**27, min(2.0**27, 64 * x))) for x in v]))
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in kept[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        told = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), t in zip(kept, told) if t == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {c: sum(d for _, x, d in last if x == c) for c in range(len(centroids))}
    return sorted(last, key=str), inertia, centroids


def held(spark, rows, k=16, rounds=3, size=64):
    df = spark.createDataFrame([(i, v, "mine", 5, "mine") for i, v in rows], KIND).repartition(5)
    got = lookup_kmeans.cluster(df, k, rounds, components=size).collect()
    want, inertia, centroids = by_hand(rows, k, rounds, size)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert all(r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values()) and r.centroid == centroids[r.cluster] for r in got)
    return got


def test_random_vectors_with_ties(spark):
    rng = np.random.default_rng(12)
    rows = [(i, list(map(float, rng.integers(-3, 4, 64) / 64))) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(200)]  # many equal vectors, and equal first centroids
    held(spark, rows)


def test_odd_vectors(spark):
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    fine = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    rows = [*fine, (0, fine[0][1]), (0, fine[0][1]), (0, [9.0] * 4), (None, [0.5] * 4), (None, [0.5] * 4), (50, None), (51, []), (52, [1.0]),
            (53, [1.0, None, 1.0, 1.0]), (54, [nan] * 4), (55, [inf, 0.0, 0.0, 0.0]), (56, [1e300, -1e300, 0.0, -0.001]), (57, [0.0] * 5)]
    got = held(spark, rows, k=6, rounds=4, size=4)
    assert {50, 51, 52, 53, 54, 55, 57}.isdisjoint({r.vec_id for r in got}) and any(r.vec_id == 56 for r in got)


def test_few_vectors_and_none(spark):
    held(spark, [(1, [0.25, -0.25]), (2, [3.0, 1.0])], size=2)
    held(spark, [(1, [0.25, -0.25])], k=1, rounds=0, size=2)
    df = spark.createDataFrame([(1, [0.5])], "vec_id bigint, embedding array<float>")
    assert lookup_kmeans.cluster(df.limit(0)).count() == 0 and lookup_kmeans.cluster(df).count() == 0


def test_an_empty_cluster_keeps_its_centroid(spark):
    # Two equal first centroids: nothing is nearest to the second one.
    names = sorted(range(60), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    rows = [(i, [1.0 if place < 2 else 2.0]) for place, i in enumerate(names)]
    got = held(spark, rows, k=3, size=1)
    assert 1 not in {r.cluster for r in got}


def test_blocks_are_bounded(spark):
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 97).cast("int"), (F.col("id") % 89).cast("int")).alias("q")).coalesce(1)
    sizes = [r.n for r in df.mapInArrow(lookup_kmeans.packed, lookup_kmeans.BLOCK_DDL).select("n").collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= lookup_kmeans.BLOCK_ROWS
