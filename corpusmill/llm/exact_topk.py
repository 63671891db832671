"""Exact top-k search by tiled matrix products.

Queries and candidates are packed into blocks of bounded size. Each tile, one query block against one shard, is one matrix
product in which the best k of every query are selected partially; the lists of a query block are merged in a tree, a few
shards at a time. Components are whole numbers, so scores and ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize

#: Rows of a query block and of a shard for 64 components; wider vectors get fewer.
QUERY_ROWS, SHARD_ROWS, COMPONENTS = 2048, 8192, 64
#: Cells of a product that a task holds at a time, and lists merged by one step of the tree.
CELLS, FAN_IN = 1 << 21, 16
SCALE = 64.0


def whole_numbers(vector: Column) -> Column:
    """floor(64 * x) of each component, in double precision; null when the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def pack(rows: DataFrame, per_block: int, name: str) -> DataFrame:
    """One row (dim, block, n, ids, values) for each block of about ``per_block`` vectors of equal length, ids ascending."""
    n = rows.groupBy("dim").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") * F.col("dim") / (per_block * COMPONENTS)))
    dealt = rows.join(F.broadcast(n.drop("n")), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))  # one row a length

    def packed(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        dim = table["dim"][0].as_py()
        values = table["q"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)[order]
        small = values.astype(np.int32) if len(values) == 0 or np.abs(values).max() < 2**31 else values
        return pa.table({"dim": [dim], "block": [table["block"][0].as_py()], "ids": [ids[order].tobytes()], "values": [small.tobytes()],
                         "wide": [small.dtype == np.int64]}, schema=BLOCK)

    return materialize(dealt.select("dim", "block", "vec_id", "q").groupBy("dim", "block").applyInArrow(
        packed, "dim int, block bigint, ids binary, values binary, wide boolean"), name)


BLOCK = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("values", pa.binary()), ("wide", pa.bool_())])
PART = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("queries", pa.binary()), ("ids", pa.binary()),
                  ("scores", pa.binary())])
PART_DDL = "dim int, block bigint, shard bigint, queries binary, ids binary, scores binary"
#: Stands in lists shorter than k.
NOTHING = np.iinfo(np.int64).min


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products. Floating point is exact while no sum can pass 2^53; wider numbers are multiplied as Python
    integers, and results beyond 64 bits end at the limits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, NOTHING + 1, np.iinfo(np.int64).max).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of each row, highest first, ties to the smaller id; ``ids`` ascends along a row or is one row for all."""
    n = scores.shape[1]
    wide = np.broadcast_to(ids, scores.shape)
    if n > k:
        # The k-th score divides: what lies above it is in, of the equal ones as many as are missing, smallest ids first.
        cut = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        above, equal = scores > cut, scores == cut
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (equal & (np.cumsum(equal, axis=1) <= room))
        scores, wide = scores[keep].reshape(len(scores), k), wide[keep].reshape(len(scores), k)
    order = np.lexsort((wide, -np.maximum(scores, NOTHING + 1)), axis=1)
    out = np.take_along_axis(scores, order, 1), np.take_along_axis(wide, order, 1)
    if n < k:
        out = tuple(np.pad(x, ((0, 0), (0, k - n)), constant_values=NOTHING) for x in out)
    return out


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """For each query the k best candidates by inner product of whole-number components: query_id, rank, vec_id, score.

    Both sides: vec_id, embedding; further columns don't matter. A query's own vec_id is no candidate for it. Rows whose
    vec_id is null, or whose vector is null, empty, or holds a null or non-finite component, take no part; vectors of
    another length are no candidates. Repeated rows count once. An empty side gives an empty result.
    """
    def ready(df: DataFrame) -> DataFrame:
        rows = df.select("vec_id", whole_numbers(F.col("embedding")).alias("q")).where("vec_id is not null and size(q) > 0")
        return rows.select("vec_id", "q", F.size("q").alias("dim")).dropDuplicates(["vec_id", "q"])

    shards = pack(ready(candidates), SHARD_ROWS, "topk-shards")
    blocks = pack(ready(queries), QUERY_ROWS, "topk-queries")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                def matrix(values, wide):
                    return np.frombuffer(values, np.int64 if wide else np.int32).reshape(-1, r["dim"])  # noqa: B023
                q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                q, c = matrix(r["q_values"], r["q_wide"]), matrix(r["c_values"], r["c_wide"])
                step, out = max(1, CELLS // len(c_ids)), []
                for i in range(0, len(q_ids), step):
                    scores = products(q[i:i + step], c)
                    own = q_ids[i:i + step, None] == c_ids[None, :]
                    scores[own] = NOTHING
                    out.append(best(scores, c_ids[None, :], k))
                scores, ids = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_pylist([{"dim": r["dim"], "block": r["block"], "shard": r["shard"], "queries": r["q_ids"],
                                                   "ids": ids.tobytes(), "scores": scores.tobytes()}], schema=PART)

    # Block numbers are counted, not assumed to be dense: an empty block has no row.
    names = ["block", "ids", "values", "wide"]
    q_side = blocks.select("dim", *[F.col(c).alias(c if c == "block" else f"q_{c}") for c in names])
    c_side = shards.select("dim", *[F.col(c).alias("shard" if c == "block" else f"c_{c}") for c in names])
    grid = blocks.select("dim", "block").join(shards.select("dim", F.col("block").alias("shard")), "dim")
    tiles = grid.join(q_side, ["dim", "block"]).join(c_side, ["dim", "shard"])
    parts = max(1, int(grid.count()))
    lists = tiles.repartition(min(parts, 16 * candidates.sparkSession.sparkContext.defaultParallelism), "block", "shard").mapInArrow(tile, PART_DDL)

    def merged(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: r["shard"])
        n = len(rows[0]["queries"]) // 8
        ids, scores = (np.concatenate([np.frombuffer(r[c], np.int64).reshape(n, k) for r in rows], axis=1) for c in ("ids", "scores"))
        order = np.argsort(ids, axis=1, kind="stable")
        s, i = best(np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1), k)
        return pa.Table.from_pylist([rows[0] | {"shard": rows[0]["shard"] // FAN_IN, "ids": i.tobytes(), "scores": s.tobytes()}], schema=PART)

    n_shards = int(shards.agg(F.max("block")).head()[0] or 0) + 1
    while n_shards > 1:
        lists = lists.groupBy("dim", "block", (F.col("shard") / FAN_IN).cast("long").alias("_up")).applyInArrow(
            lambda key, table: merged(table), PART_DDL)
        n_shards = -(-n_shards // FAN_IN)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, ids, scores = (np.frombuffer(r[c], np.int64) for c in ("queries", "ids", "scores"))
                rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(q))
                real = scores != NOTHING
                yield pa.RecordBatch.from_arrays([pa.array(x[real]) for x in (np.repeat(q, k), rank, ids, scores)],
                                                 ["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(unpacked, "query_id bigint, rank int, vec_id bigint, score bigint")
