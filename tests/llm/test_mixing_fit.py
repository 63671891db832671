"""Budgets that only certain documents meet, longer than the table, and rows that share an id."""

import numpy as np

from corpusmill.llm import mixing


def test_few_long_documents():
    sizes, ones = np.array([500_000, 600_000, 1_000_000]), np.ones(3, dtype=np.int64)
    assert mixing.fit(sizes, ones, 1_100_000).tolist() == [1, 1, 0]


def test_long_documents_against_all_subsets():
    rng = np.random.default_rng(8)
    for _ in range(60):
        sizes, counts = np.unique(rng.integers(1, 900_000, 5)), rng.integers(1, 4, 5)
        counts = counts[:len(sizes)]
        budget = int(rng.integers(1, (sizes * counts).sum() + 1))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        got = mixing.fit(sizes, counts, budget)
        assert (got <= counts).all() and (sizes * got).sum() == max(x for x in sums if x <= budget)


def test_more_sums_than_are_listed(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SUMS", 50)
    rng = np.random.default_rng(9)
    for _ in range(60):
        sizes = np.unique(rng.integers(200_000, 900_000, 12))
        budget = int(sizes.sum() // 2)
        got = mixing.listed_knapsack(sizes, np.ones(len(sizes), dtype=np.int64), budget)
        assert (got <= 1).all() and 0.9 * budget < (sizes * got).sum() <= budget


def test_rows_of_one_id_meet_the_target(spark):
    text = "a b c d e"
    rows = [(1, text, "a")] * 12 + [(None, text, "b")] * 12 + [(9, text, "c")] * 4 + [(i, text, "c") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and list(got.columns[:3]) == ["doc_id", "text", "source"]
    for _, own in got.groupby("source"):
        assert own.target.iloc[0] - 5 < own.taken.sum() <= own.target.iloc[0] + 0.5


def test_targets_of_a_table_follow_the_rule(spark):
    import math
    import random
    rng = random.Random(8)
    for case in range(6):
        names = [f"s{i}" if i % 7 else f"\u00e9{i}" for i in range(rng.choice([1, 3, 40]))] + [None] * (case % 2)
        sizes = {n: rng.choice([0, 1, rng.randrange(50), rng.randrange(10**6)]) for n in names}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.target_table(rows).collect()}
        want = mixing.targets(sizes, sum(sizes.values()))
        assert got.keys() == want.keys() and all(math.isclose(got[n], want[n], rel_tol=1e-9, abs_tol=1e-6) for n in want)


def test_more_sources_than_fit_a_driver(spark):
    docs = spark.range(120_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 3 AS int)) AS text", "concat('s', id) AS source")
    rows = mixing.mix(docs)
    out = rows.selectExpr("count(*) AS n", "sum(taken) AS taken", "sum(size) AS size", "max(taken / size) AS most").head()
    assert out.n == 120_000 and out.most <= 3 and abs(out.taken / out.size - 1) < 0.5
