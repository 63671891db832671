"""Vector search: odd vectors, scopes, balls and their bounds against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dense

NAN, INF = float("nan"), float("inf")
VECTORS, QUERIES = "id bigint, vec array<float>, key string", "qid bigint, qvec array<float>, scope array<string>"


def plain(queries, vectors, k):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)

    out = {}
    for q, vec, scope in queries:
        if fine(vec):
            a = np.array(vec, np.float32).astype(float)
            hits = [(-round(float(a @ np.array(v, np.float32).astype(float)), 9), i) for i, v, key in vectors
                    if fine(v) and len(v) == len(vec) and (not scope or key is None or key in scope)]
            out |= {(q, r): i for r, (_, i) in enumerate(sorted(hits)[:k], 1)}
    return out


def frames(spark, queries, vectors):
    return spark.createDataFrame(queries, QUERIES).repartition(3), spark.createDataFrame(vectors, VECTORS).repartition(4)


def ranks(df):
    return {(r.qid, r["rank"]): r.id for r in df.collect()}


def by_balls(q, v, k):
    """The route for much work, whatever the work."""
    return dense.dense_topk(q, v, k, limit=1)


ODD = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.6, 0.8, 0.0], None, [], [1.0, None, 0.0], [NAN, 0.0, 1.0], [INF, 0.0, 0.0], [1.0, 0.0], [0.0, -1.0], [0.5] * 5, [0.25] * 4]


@pytest.mark.parametrize("search", [dense.dense_topk, by_balls])
def test_odd_vectors_on_both_sides(spark, search):
    vectors = [(i, v, [None, "a", "b"][i % 3]) for i, v in enumerate(ODD * 3)]
    queries = [(i, v, [[], ["a"], ["b", "none"]][i % 3]) for i, v in enumerate(ODD[::-1])]
    q, v = frames(spark, queries, vectors)
    assert ranks(search(q, v, 4)) == plain(queries, vectors, 4)
    assert search(q, v.limit(0), 4).count() == 0 and search(q.limit(0), v, 4).count() == 0
    bad = v.where("vec IS NULL")
    assert search(q, bad, 4).count() == 0


def clustered(rng, n, groups, dims=16, spread=0.05):
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("block", [16 * 1024 * 1024, 16 * 8 * 40])
def test_balls_equal_brute_force(spark, monkeypatch, block):
    """Clustered and shapeless vectors, equal ones, longer ones, scopes; whole cells and cells of forty vectors."""
    monkeypatch.setattr(dense, "BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    x = np.concatenate([clustered(rng, 500, 12), rng.normal(size=(200, 16)).astype(np.float32) * 3])
    x[600:660] = x[0]
    vectors = [(i, x[i].tolist(), [None, "a", "b", "c"][i % 4]) for i in range(len(x))]
    queries = [(i, (x[(7 * i) % len(x)] * (1 + i % 2)).tolist(), [[], ["a"], ["b", "c"], ["none"]][i % 4]) for i in range(120)]
    q, v = frames(spark, queries, vectors)
    want = plain(queries, vectors, 6)
    assert ranks(by_balls(q, v, 6)) == want and ranks(dense.dense_topk(q, v, 6)) == want


def test_fewer_products_on_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 6000, 60, spread=0.02)
    vectors = [(i, x[i].tolist(), None) for i in range(len(x))]
    queries = [(i, x[i * 9].tolist(), []) for i in range(200)]
    q, v = frames(spark, queries, vectors)
    q = q.withColumn("dim", F.size("qvec"))
    dealt = dense.DealtVectors(v.withColumn("dim", F.size("vec")), len(x))
    first = dealt.reached(q, False)
    lists = dealt.lists(q.withColumn("bar", F.lit(None).cast("double")), first, 10)
    bars = dense.merged(lists, 10).where(F.col("rank") == 10).select("qid", F.col("cosine").alias("bar"))
    more = dealt.reached(q.join(bars, "qid", "left"), True)
    products = first.unionByName(more).join(dealt.sizes, ["dim", "ball"]).agg(F.sum("n")).head()[0]
    assert products < 0.1 * len(queries) * len(vectors), products
    assert ranks(by_balls(q, v, 10)) == ranks(dense.dense_topk(q, v, 10))


def test_what_is_out_of_scope_is_not_multiplied():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(100, 4))
    keys = [None if i < 10 else f"k{i % 9}" for i in range(100)]
    best = dense.Best(np.arange(6), rng.normal(size=(6, 4)), [["k1"], ["k1"], ["none"], ["k1", "k2"], [], []], 3)
    best.add(np.arange(100), v, keys)
    seen = [sum(k is None or not s or k in s for k in keys) for s in (["k1"], ["k1"], ["none"], ["k1", "k2"], [], [])]
    assert best.products == sum(seen)


def test_a_ball_of_most_vectors_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 4 * 8 * 50)
    vectors = [(i, [1.0, 0.0, 0.0, 0.0] if i % 3 else [0.0, 1.0, 0.0, float(i)], None) for i in range(600)]
    queries = [(i, [1.0, 0.1, 0.0, 0.0], []) for i in range(110)]
    q, v = frames(spark, queries, vectors)
    assert ranks(by_balls(q, v, 3)) == {(i, r): (1, 2, 4)[r - 1] for i in range(110) for r in (1, 2, 3)}


@pytest.mark.parametrize("scoped", [False, True])
def test_shapeless_vectors_are_not_sent_to_every_ball(spark, monkeypatch, scoped):
    """Random vectors, whose balls rule out next to nothing: queries go to blocks of vectors, not to each ball."""
    sent, plain_write = {}, dense.materialize

    def write(df, name):
        out = plain_write(df, name)
        sent[name] = sent.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(dense, "materialize", write)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[500:] = x[0]
    vectors = [(i, x[i].tolist(), f"k{i % 5}") for i in range(600)]
    queries = [(i, x[i].tolist(), [f"k{i % 6}"] if scoped else []) for i in range(0, 600, 4)]
    q, v = frames(spark, queries, vectors)
    assert ranks(by_balls(q, v, 5)) == plain(queries, vectors, 5)
    assert sent["dense-pairs"] <= len(queries)


def test_long_and_tiny_vectors_keep_their_order():
    """Lengths that single precision cannot multiply, and scores that differ by less than it can tell."""
    for scale in (1e18, 1.0, 1e-3):
        v = np.array([[1.0, 0.0], [1.0 - 3e-8, 0.0], [1.0, 0.0], [1.0 + 3e-8, 0.0]] * 50) * scale
        best = dense.Best(np.arange(2), np.array([[1.0, 0.0], [scale, 0.0]]), [[], []], 3)
        best.add(np.arange(200)[::-1], v[::-1], [None] * 200)
        want = np.round(np.array([[1.0, 0.0], [scale, 0.0]]) @ v.T, dense.SCORE_DIGITS)
        assert best.ids.tolist() == [np.lexsort((np.arange(200), -row))[:3].tolist() for row in want]
