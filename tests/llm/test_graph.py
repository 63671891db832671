"""Components of links that no single task holds."""

import random

import pytest

from corpusmill.llm import graph

CHAINS = {
    "falling": [(i + 1, i) for i in range(300)],
    "rising and falling ids": [(k, j) for k, j in zip(*(lambda x: (x, x[1:]))(random.Random(1).sample(range(1000), 300)))],
    "three": [(3, 2), (2, 1)],
    "two chains and a star": [(i + 2, i) for i in range(120)] + [(1000 + i, 999) for i in range(60)],
}


def smallest(links):
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for link in links for x in link if find(x) != x}


@pytest.mark.parametrize("name", CHAINS)
def test_chains_over_many_tasks(spark, monkeypatch, name):
    links = CHAINS[name]
    written = []

    def counted(df, label, write=graph.materialize):
        written.append(label)
        assert len(written) < 40, "rounds without end"
        # Dealt by ranges of ids, a row and the row of its root seldom meet in one task.
        return write(df.repartitionByRange(8, "node"), label)
    monkeypatch.setattr(graph, "materialize", counted)
    monkeypatch.setattr(graph, "LINKS_A_TASK", 1 if len(links) < 10 else 10)
    df = spark.createDataFrame(random.Random(2).sample(links, len(links)), "a bigint, b bigint").repartitionByRange(8, "a")
    rows = [tuple(r) for r in graph.components(df).collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == smallest(links)
    assert "edges" in written
