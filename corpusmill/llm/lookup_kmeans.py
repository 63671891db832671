"""Centroid clustering of whole-number vectors with scalar lookup tables.

Vectors are packed into blocks once: for every dimension the values that occur in the block, and for every vector the places
of its components among them. A round tabulates the squared difference of each dimension, occurring value and centroid;
the distance of a vector to all centroids is then the sum of one table row per dimension, gathered by place. Each block
returns counts and component sums of its clusters, Spark adds them up, and the new centroids, k rows, go to the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded
from corpusmill.session import materialize

COMPONENTS, CLUSTERS, ROUNDS, SEED = 64, 16, 3, 1
SCALE = 64.0
#: Whole numbers end at this size in either direction, so that every squared distance fits into 64 bits.
MOST = 2**27
#: Vectors of a block, and vectors whose distances are gathered at a time.
BLOCK_ROWS, STEP = 8192, 2048
BLOCK = pa.schema([("n", pa.int32()), ("ids", pa.binary()), ("no_id", pa.binary()), ("cuts", pa.binary()), ("values", pa.binary()),
                   ("places", pa.binary())])
BLOCK_DDL = "n int, ids binary, no_id binary, cuts binary, values binary, places binary"
SUMS_DDL = "cluster int, n bigint, sums array<bigint>"


def whole_numbers(vector: Column, components: int = COMPONENTS) -> Column:
    """floor(64 * x) of each component in double precision; null unless there are ``components``, all finite."""
    fine = (F.size(vector) == components) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST))))
    return F.when(fine, F.transform(vector, lambda x: scaled(x).cast("int")))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK_ROWS vectors of the rows of a task; their order within the table doesn't matter."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids = table["vec_id"].combine_chunks()
        rows = table["q"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        # Columns that know their values and, for each vector, the place of its own.
        found = [np.unique(rows[:, d], return_inverse=True) for d in range(rows.shape[1])]
        cuts = np.cumsum([0] + [len(v) for v, _ in found]).astype(np.int32)
        places = np.stack([p for _, p in found], axis=1).astype(np.uint16)
        return pa.RecordBatch.from_pylist([{
            "n": len(ids), "ids": ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), "no_id": ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
            "cuts": cuts.tobytes(), "values": np.concatenate([v for v, _ in found]).astype(np.int32).tobytes(), "places": places.tobytes()}], schema=BLOCK)

    n = 0
    for batch in batches:
        for start in range(0, len(batch), BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            if n + len(part) > BLOCK_ROWS:
                yield flush()
                held, n = [], 0
            held.append(part)
            n += len(part)
    if n:
        yield flush()


class Block:
    """A packed block: ids (null where there is none), values by dimension, and places."""

    def __init__(self, row: dict):
        self.n = row["n"]
        self.ids = np.ma.masked_array(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], np.bool_))
        self.cuts = np.frombuffer(row["cuts"], np.int32)
        self.values = np.frombuffer(row["values"], np.int32).astype(np.int64)
        self.places = np.frombuffer(row["places"], np.uint16).reshape(self.n, -1)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each vector, ties to the smaller number, and its squared distance."""
        dims = len(self.cuts) - 1
        # One row for each dimension and occurring value, one column for each centroid.
        owner = np.repeat(np.arange(dims), np.diff(self.cuts))
        table = (self.values[:, None] - centroids.T[owner]) ** 2
        best, least = np.empty(self.n, np.int32), np.empty(self.n, np.int64)
        for start in range(0, self.n, STEP):
            places = self.places[start:start + STEP]
            sums = np.zeros((len(places), len(centroids)), np.int64)
            for d in range(dims):
                sums += table[self.cuts[d]:self.cuts[d + 1]][places[:, d]]
            best[start:start + STEP] = sums.argmin(axis=1)
            least[start:start + STEP] = sums.min(axis=1)
        return best, least

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and exact component sums of each cluster: how often each value occurs there, times the value."""
        dims = len(self.cuts) - 1
        out = np.zeros((k, dims), np.int64)
        for d in range(dims):
            values = self.values[self.cuts[d]:self.cuts[d + 1]]
            often = np.bincount(cluster.astype(np.int64) * len(values) + self.places[:, d], minlength=k * len(values))
            out[:, d] = often.reshape(k, len(values)) @ values
        return np.bincount(cluster, minlength=k), out


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of what is nearest to each; those that nothing is nearest to stay."""
    k, dims = centroids.shape

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                one, more = block.sums(block.nearest(centroids)[0], k)
                n += one
                sums += more
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])

    added = blocks.mapInArrow(counted, SUMS_DDL).groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(dims)]).alias("sums"))
    out = centroids.copy()
    for row in added.where("n > 0").collect():  # one row a cluster
        out[row.cluster] = [s // row.n for s in row.sums]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia and centroid (array).

    ``vectors``: vec_id, embedding; further columns don't matter. Vectors that are null, of another length, or hold a null or
    non-finite component take no part. Components are floor(64 * x), held between -2^27 and 2^27. The first centroids are the
    ``k`` vectors with the smallest sha256 of ``seed:vec_id`` (a null id counts as the empty text; of rows that repeat an
    id, the smaller vector first). Repeated rows count as often as they come; equal centroids lose to the smaller number and
    stay where they are. Fewer vectors than ``k`` give as many clusters; an empty table gives an empty one. Sums beyond 64 bits
    end at the largest number.
    """
    bounded(vectors.sparkSession)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), components).alias("q")).where("q is not null")
    blocks = materialize(kept.mapInArrow(packed, BLOCK_DDL), "kmeans-blocks")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(drawn.alias("h"), "vec_id", "q").orderBy("h", "vec_id", "q").limit(k).collect()  # k rows
    centroids = np.array([r.q for r in first], dtype=np.int64).reshape(-1, components)
    for _ in range(rounds if len(first) else 0):
        centroids = moved(blocks, centroids)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                best, least = block.nearest(centroids)
                ids = pa.array(block.ids.data, pa.int64(), mask=block.ids.mask)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best), pa.array(least)], ["vec_id", "cluster", "distance"])

    rows = materialize(blocks.mapInArrow(told, "vec_id bigint, cluster int, distance bigint"), "kmeans-rows")
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)"))
    each = rows.groupBy("cluster").agg(total("distance").alias("own"))
    spark = vectors.sparkSession
    ends = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<bigint>")
    named = each.join(F.broadcast(ends), "cluster").select(  # one row a cluster
        "cluster", F.col("own").cast("long").alias("cluster_inertia"), "centroid")
    inertia = each.agg(total("own").cast("long"))
    return rows.join(F.broadcast(named.withColumn("inertia", inertia.scalar())), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
