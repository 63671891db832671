"""Connected components of links between ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize

STAR = "node bigint, root bigint"
#: Links that one task contracts; about 100 bytes of memory each.
LINKS_A_TASK = 1_000_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (node, smallest id it reaches) of the links of one partition."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
    stars = [(x, find(x)) for x in list(parent) if find(x) != x]
    for i in range(0, len(stars), 100_000):
        part = np.array(stars[i:i + 100_000], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every id that reaches a smaller one through ``links`` (a, b); root is the smallest id reached.

    ``links`` should be a written table: it is counted, and read by as many tasks as hold LINKS_A_TASK links each. Each
    task contracts its own links to stars; the roots that different tasks give the same node are linked, and every root
    that is a node itself gives way to its own least root, wherever the two rows lie. So each round halves all chains of
    least roots, and roots only get smaller; a round that leaves neither such nodes nor such roots ends it. Nothing is
    gathered in one place.
    """
    edges, found = links.select(F.col("a").alias("node"), F.col("b").alias("root")), links.count()
    while True:
        tasks = -(-found // LINKS_A_TASK) or 1
        stars = materialize(edges.coalesce(tasks).mapInArrow(contract, STAR), "stars")
        if tasks == 1:
            return stars
        joined = stars.join(least_roots(stars), "node")
        # A root that has a smaller root elsewhere is a node too.
        hooked = materialize(joined.select("node", F.col("least").alias("root")).union(
            joined.where("root > least").select(F.col("root").alias("node"), F.col("least").alias("root"))).distinct(), "hooked")
        above = least_roots(hooked).withColumnRenamed("node", "root")
        edges = materialize(hooked.join(above, "root", "left").select("node", F.coalesce("least", "root").alias("root")).distinct(), "edges")
        found = edges.count()
        nodes = edges.select("node").distinct()
        if nodes.count() == found and not edges.select(F.col("root").alias("node")).join(nodes, "node", "left_semi").limit(1).count():
            return edges


def least_roots(stars: DataFrame) -> DataFrame:
    return stars.groupBy("node").agg(F.min("root").alias("least"))
