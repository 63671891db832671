"""Keyword search with score bounds: same hits as adding everything up, fewer documents met, frequent terms spread."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lexical


def plain(docs, queries, k, k1=1.5, b=0.75, epsilon=0.25):
    """Scores of all documents, one by one."""
    n, mean = len(docs), sum(len(t) for _, t, _ in docs) / max(1, len(docs))
    df = {}
    for _, terms, _ in docs:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = epsilon * sum(raw.values()) / max(1, len(raw))
    idf = {t: floor if x < 0 else x for t, x in raw.items()}
    out = {}
    for q, terms, scope in queries:
        hits = []
        for i, words, key in docs:
            if scope and key is not None and key not in scope:
                continue
            f = {}
            for w in words:
                f[w] = f.get(w, 0) + 1
            score = sum(idf[t] * f[t] * (k1 + 1) / (f[t] + k1 * (1 - b + b * len(words) / mean)) for t in terms if t in f)
            if round(score, 9) > 0:
                hits.append((-round(score, 9), i))
        for rank, (score, i) in enumerate(sorted(hits)[:k], 1):
            out[q, rank] = (i, -score)
    return out


def frames(spark, docs, queries):
    return (spark.createDataFrame(queries, "qid bigint, terms array<string>, scope array<string>"),
            spark.createDataFrame(docs, "id bigint, terms array<string>, key string").repartition(4))


def same(spark, docs, queries, k):
    q, d = frames(spark, docs, queries)
    got = {(r.qid, r["rank"]): (r.id, r.score) for r in lexical.bm25_topk(q, d, k).collect()}
    want = plain(docs, queries, k)
    assert {x: i for x, (i, _) in got.items()} == {x: i for x, (i, _) in want.items()}
    assert all(math.isclose(got[x][1], want[x][1], abs_tol=2e-9) for x in want)
    return q, d


def corpus(rng, n, words=40):
    """Every document has the term ``all``; others come by Zipf's law."""
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, ["all"] * rng.randrange(1, 4) + rng.choices(vocabulary, weights, k=rng.randrange(0, 30)), rng.choice([None, "a", "b", "c"])) for i in range(n)]


@pytest.mark.parametrize("spread,prune", [(7, 0), (100_000, 0), (7, 10**9)])
def test_same_hits_as_scoring_everything(spark, monkeypatch, spread, prune):
    monkeypatch.setattr(lexical, "SPREAD", spread)
    monkeypatch.setattr(lexical, "PRUNE_FROM", prune)
    rng = random.Random(spread)
    docs = corpus(rng, 400)
    queries = [(q, rng.choices([f"w{i}" for i in range(45)], k=rng.randrange(0, 9)) + ["all"] * (q % 2), [[], ["a"], ["b", "c"], ["none"]][q % 4]) for q in range(60)]
    queries += [(900, ["all"], []), (901, ["w39"], ["a"]), (902, ["absent"], []), (903, [], [])]
    for k in (1, 5):
        same(spark, docs, queries, k)


@pytest.mark.parametrize("prune", [0, 10**9])
def test_small_and_lopsided_corpora(spark, monkeypatch, prune):
    monkeypatch.setattr(lexical, "PRUNE_FROM", prune)
    same(spark, [(1, ["x"], None)], [(0, ["x", "x", "y"], [])], 3)
    same(spark, [(i, ["x"] * (i % 3 + 1) + ["y"], None) for i in range(12)], [(0, ["x", "y"], []), (1, ["y"], ["k"])], 4)  # mean weight below zero
    q, d = frames(spark, [(1, ["x"], None)], [(0, ["x"], [])])
    assert lexical.bm25_topk(q.limit(0), d, 3).count() == 0 and lexical.bm25_topk(q, d.limit(0), 3).count() == 0
    assert lexical.bm25_topk(q, d.withColumn("terms", F.array().cast("array<string>")), 3).count() == 0


def prepared(spark, docs, queries, k):
    q, d = frames(spark, docs, queries)
    counts = lexical.corpus_counts(d)
    asked = q.select("qid", "scope", F.explode("terms").alias("term")).groupBy("qid", "scope", "term").agg(F.count("*").alias("mult"))
    weights = asked.join(lexical.corpus_stats(counts), "term").select("term", "qid", "scope", (F.col("mult") * F.col("idf")).alias("weight"))
    found = lexical.Postings(lexical.postings(d, asked.select("term").distinct(), lexical.mean_length(counts).scalar(), 1.5, 0.75))
    terms = lexical.term_bounds(weights, found, k)
    return found, lexical.with_bars(terms, lexical.first_bars(terms, found, k))


def test_a_term_of_every_document_is_hardly_met(spark, monkeypatch):
    """Rare words and one that stands everywhere: a tenth of the pairs, at most, and the same hits."""
    monkeypatch.setattr(lexical, "PRUNE_FROM", 0)
    rng = random.Random(1)
    docs = [(i, ["all", *rng.choices([f"r{j}" for j in range(300)], k=4), *rng.choices([f"n{j}" for j in range(5000)], k=rng.randrange(3, 9))], None)
            for i in range(4000)]
    queries = [(q, ["all", *rng.sample([f"r{j}" for j in range(300)], 3)], []) for q in range(30)]
    same(spark, docs, queries, 5)
    found, rows = prepared(spark, docs, queries, 5)
    assert rows.where("NOT pruned").count() == 0
    before = rows.select("qid", "term").join(found.rows, "term").select("qid", "id").distinct().count()
    strong = rows.where("pruned AND strong")
    candidates = lexical.met(strong, found, True).where("given + rest >= bar").select("qid", "id").distinct().count()
    assert before == 30 * 4000 and 0 < candidates <= before / 10
    assert lexical.contenders(rows, found).count() <= candidates
    assert strong.where("term = 'all'").count() == 0


def test_a_frequent_term_is_spread(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SPREAD", 100)
    docs = [(i, ["all", f"x{i}"], None) for i in range(1000)]
    found, rows = prepared(spark, docs, [(0, ["all"], []), (1, ["all", "x7"], [])], 5)
    assert rows.where("term = 'all'").select("lists").distinct().collect()[0][0] == 10
    lists = found.dealt().where("term = 'all'").groupBy("list").count().collect()
    assert len(lists) == 10 and max(r["count"] for r in lists) < 200
    # Where more terms than a broadcast may hold would be spread, lists grow with the postings.
    monkeypatch.setattr(lexical, "SPREAD_TERMS", 0.001)
    assert lexical.Postings(found.rows).bounds.where("lists > 1").count() == 0
