"""Exact vector search: every query against every vector in its scope that may matter, top k, no approximation.

Routes with equal results. Few query vectors, or little work, are scored where the vectors lie: each task keeps its best
k per query and only those travel. Otherwise vectors are dealt into balls, each with a centre and the distance of its
farthest member. A query first meets the ball it points to; its k-th score there is a bar, and of the other balls it meets
only those whose centre's score plus radius reach the bar. Queries and vectors of a ball are cut into cells of bounded
size, and the lists that cells return are merged in two steps. Where the bars rule out too few balls (shapeless vectors, narrow
scopes), blocks of queries meet blocks of vectors instead, with the same bars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.session import BROADCAST_BYTES, materialize

SCORE_DIGITS = 9
# One block of vectors, and one of query vectors, in a cell: larger blocks mean fewer copies, smaller ones
# mean shorter tasks and less to repeat when one is lost.
BLOCK_BYTES = 16 * 1024 * 1024
# No score matrix in a task is larger than this many cells, or has more queries; so many pairs are scored apart at once.
CELLS, ROWS, PAIRS = 4_000_000, 2_048, 65_536
# Multiplications from which on vectors are dealt into balls, if there are more queries than a vector has centres to be compared with.
BALL_WORK = 4e9
# Centres a level (balls are their square at most), vectors they are learned from, and rounds.
CENTRES, SAMPLE, ROUNDS = 48, 16_384, 4
# Blocks on either side that tiles have at least; most tasks that tiles are dealt to; and the share of all products up to which balls are met one by one.
TILES, TILE_TASKS, BALL_SHARE = 4, 4_096, 0.25
# Lists of one query that the first step of the merge puts together.
LOTS = 64
OUT = "qid bigint, id bigint, cosine double"


def usable(vector: Column) -> Column:
    """Whether a vector can be scored: it has components, and all of them are numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Best:
    """Best k (score, id) per query over the rows seen so far. ``products``: multiplied pairs; ``bars``: what a score must reach.

    Pairs are multiplied in single precision first; only those that its error bound leaves in doubt are scored in double.
    """

    def __init__(self, qids: np.ndarray, vectors: np.ndarray, scopes: list, k: int, bars: np.ndarray | None = None):
        self.qids, self.vectors, self.k, self.products = qids, vectors, k, 0
        self.bars = np.full(len(qids), -np.inf) if bars is None else bars
        self.long = np.sqrt((vectors ** 2).sum(axis=1))
        self.scores = np.full((len(qids), k), -np.inf)
        self.ids = np.zeros((len(qids), k), dtype=np.int64)
        # Queries of one scope meet the same vectors.
        self.groups: dict[frozenset | None, list[int]] = {}
        for i, scope in enumerate(scopes):
            self.groups.setdefault(frozenset(scope) if scope else None, []).append(i)

    def add(self, ids: np.ndarray, vectors: np.ndarray, keys: list) -> None:
        if not len(ids):
            return
        at: dict = {}
        if any(scope is not None for scope in self.groups):
            for i, key in enumerate(keys):
                at.setdefault(key, []).append(i)
        for scope, group in self.groups.items():
            rows = np.array(group)
            if scope is None:
                self.multiply(rows, ids, vectors)
                continue
            # What a query may not see is not multiplied.
            seen = np.array(sorted(i for key in (*scope, None) for i in at.get(key, ())), dtype=np.int64)
            if len(seen):
                self.multiply(rows, ids[seen], vectors[seen])

    def multiply(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.products += len(rows) * len(ids)
        longest = np.sqrt((vectors ** 2).sum(axis=1).max())
        # Single precision has an exponent too small for very long vectors.
        kind = np.float32 if max(longest, self.long[rows].max(), 1.0) < 1e15 else np.float64
        single, step = vectors.astype(kind), max(1, CELLS // min(len(rows), ROWS))
        for first in range(0, len(rows), ROWS):
            own = rows[first:first + ROWS]
            asked = self.vectors[own].astype(kind)
            slack = (vectors.shape[1] + 4) * np.finfo(np.float32).eps * self.long[own] * longest + 2 * 10.0 ** -SCORE_DIGITS
            for start in range(0, len(ids), step):
                part = slice(start, start + step)
                rough = asked @ single[part].T
                floor = np.maximum(self.bars[own], self.scores[own, -1]) - slack
                if rough.shape[1] > self.k and not np.isfinite(floor).all():
                    floor = np.maximum(floor, np.partition(rough, -self.k, axis=1)[:, -self.k] - 2 * slack)
                at = np.flatnonzero(rough >= floor.astype(kind)[:, None])
                if len(at):
                    self.settle(own, ids[part], vectors[part], at)

    def settle(self, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> None:
        """Scores the cells ``at`` of queries times vectors in double and keeps the best."""
        i, j = np.divmod(at, len(ids))
        if len(at) * 16 > len(own) * len(ids):
            exact = (self.vectors[own] @ vectors.T).ravel()[at]
        else:
            exact = np.concatenate([np.einsum("ij,ij->i", self.vectors[own[i[s:s + PAIRS]]], vectors[j[s:s + PAIRS]]) for s in range(0, len(at), PAIRS)])
        exact, i, found = np.round(exact, SCORE_DIGITS), own[i], ids[j]
        # score descending, then id ascending; ties stay exact
        last, last_id = self.scores[i, -1], self.ids[i, -1]
        keep = (exact >= self.bars[i]) & ((exact > last) | ((exact == last) & (found < last_id)))
        if not keep.any():
            return
        i, exact, found = i[keep], exact[keep], found[keep]
        touched = np.unique(i)
        i = np.concatenate([np.repeat(touched, self.k), i])
        exact = np.concatenate([self.scores[touched].ravel(), exact])
        found = np.concatenate([self.ids[touched].ravel(), found])
        order = np.lexsort((found, -exact, i))
        i, exact, found = i[order], exact[order], found[order]
        # Every touched query has k places at least, some of them empty.
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < self.k
        self.scores[i[top], place[top]], self.ids[i[top], place[top]] = exact[top], found[top]

    def table(self, bars: np.ndarray | None = None) -> pa.RecordBatch:
        """The lists, without what lies below ``bars``."""
        kept = np.isfinite(self.scores)
        if bars is not None:
            kept &= self.scores >= bars[:, None]
        rows, cols = np.nonzero(kept)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.qids[rows]), pa.array(self.ids[rows, cols]), pa.array(self.scores[rows, cols])],
            names=["qid", "id", "cosine"])


def _scored_in_place(queries: pa.Table, vectors: DataFrame, k: int) -> DataFrame:
    by_dim = {}
    for dim in sorted(set(queries["dim"].to_pylist())):
        own = queries.filter(pa.compute.equal(queries["dim"], dim))
        by_dim[dim] = (own["qid"].to_numpy(), matrix(own["qvec"]), own["scope"].to_pylist())
    payload = vectors.sparkSession.sparkContext.broadcast(by_dim)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(*own, k) for dim, own in payload.value.items()}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in best:
                    rows = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
                    best[dim].add(rows["id"].to_numpy(), matrix(rows["vec"]), rows["key"].to_pylist())
        for own in best.values():
            yield own.table()

    return vectors.mapInArrow(score, OUT)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - 0.5 * (centres ** 2).sum(axis=1), axis=1)


def settled(rows: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` centres of ``rows``, moved to the mean of what is nearest to them for a few rounds."""
    centres = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)].copy()
    for _ in range(ROUNDS):
        at = nearest(rows, centres)
        for c in np.unique(at):
            centres[c] = rows[at == c].mean(axis=0)
    return centres


class Balls:
    """Two levels of centres for the vectors of one length: the first tells where to look among the second."""

    def __init__(self, sample: np.ndarray, n: int):
        self.first = settled(sample, n)
        at = nearest(sample, self.first)
        self.second = [settled(sample[at == c], n) if (at == c).any() else self.first[c:c + 1] for c in range(len(self.first))]
        self.start = np.cumsum([0] + [len(c) for c in self.second])
        self.centres = np.concatenate(self.second)

    def of(self, rows: np.ndarray) -> np.ndarray:
        above, out = nearest(rows, self.first), np.empty(len(rows), dtype=np.int64)
        for c in np.unique(above):
            mine = above == c
            out[mine] = self.start[c] + nearest(rows[mine], self.second[c])
        return out


class DealtVectors:
    """Vectors (id, vec, key, dim) dealt into balls, and what is known of each ball: centre, radius and size.

    Centres are learned from a bounded sample; which ball a vector is in never changes a result. ``known``: for each length,
    the numbers of its balls, their centres, radii and sizes; at most CENTRES squared rows each.
    """

    def __init__(self, vectors: DataFrame, n: int):
        sample = vectors.select("dim", "vec", F.xxhash64("id").alias("turn")).orderBy("turn", "dim").limit(SAMPLE).toArrow()
        # About as many balls as a ball has vectors, and no more than the sample can tell apart.
        width = int(np.clip(np.ceil(min(n, SAMPLE) ** 0.25), 2, CENTRES)) if n < SAMPLE else CENTRES
        dims = sample["dim"].to_numpy()
        learned = {d: Balls(matrix(sample["vec"].combine_chunks().filter(pa.array(dims == d))), width) for d in np.unique(dims).tolist()}
        payload = vectors.sparkSession.sparkContext.broadcast(learned)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, ball, far = batch["dim"].to_numpy(), np.zeros(len(batch), np.int64), np.zeros(len(batch))
                for d in np.unique(dims).tolist():
                    mine = dims == d
                    rows = matrix(batch["vec"].filter(pa.array(mine)))
                    balls = payload.value.get(d)
                    # A length that the sample lacks is one ball around zero.
                    ball[mine] = balls.of(rows) if balls else 0
                    centres = balls.centres[ball[mine]] if balls else 0.0
                    far[mine] = np.sqrt(((rows - centres) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.array(far)], [*batch.schema.names, "ball", "far"])

        kind = vectors.schema["vec"].dataType.simpleString()
        self.rows = materialize(vectors.select("id", "vec", "key", "dim").mapInArrow(
            dealt, f"id bigint, vec {kind}, key string, dim int, ball bigint, far double"), "dense-balls")
        self.sizes = materialize(self.rows.groupBy("dim", "ball").agg(F.count("*").alias("n"), F.max("far").alias("radius")), "dense-sizes")
        self.known = {}
        for r in self.sizes.orderBy("dim", "ball").collect():  # one row a ball
            centre = learned[r.dim].centres[r.ball] if r.dim in learned else np.zeros(r.dim)
            self.known.setdefault(r.dim, []).append((r.ball, centre, r.radius, r.n))
        self.known = {d: tuple(np.array(x) for x in zip(*rows)) for d, rows in self.known.items()}

    def reached(self, queries: DataFrame, others: bool) -> DataFrame:
        """(qid, dim, ball) of the ball that a query points to most or, for ``others``, of all other balls whose centre's score
        plus radius reach the query's bar (null: none, every ball is reached)."""
        return materialize(self.pairs(queries, others), "dense-pairs")

    def meetings(self, queries: DataFrame) -> tuple[int, int]:
        """How many (query, ball) pairs ``reached`` would return for the other balls, and the products behind them; only
        counts leave the tasks."""
        met = self.pairs(queries, True, counted=True).agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("products"), F.lit(0)))
        return tuple(met.head())

    def pairs(self, queries: DataFrame, others: bool, counted: bool = False) -> DataFrame:
        payload = queries.sparkSession.sparkContext.broadcast(self.known)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d in np.unique(batch["dim"].to_numpy()).tolist():
                    if d not in payload.value:
                        continue
                    rows = batch.filter(pa.compute.equal(batch["dim"], d))
                    balls, centres, radii, sizes = payload.value[d]
                    step = max(1, CELLS // len(balls))
                    for start in range(0, len(rows), step):
                        part = rows.slice(start, step)
                        q = matrix(part["qvec"])
                        scores = q @ centres.T
                        long = np.sqrt((q ** 2).sum(axis=1))[:, None]
                        first = np.argmax(scores, axis=1)
                        if others:
                            bars = part["bar"].fill_null(-np.inf).to_numpy()[:, None]
                            slack = 1e-8 + 1e-12 * long * (np.sqrt((centres ** 2).sum(axis=1)) + radii)
                            alive = scores + long * radii + slack >= bars
                            alive[np.arange(len(q)), first] = False
                            if counted:
                                met = alive.sum(axis=0)
                                yield pa.RecordBatch.from_arrays([pa.array([int(met.sum())]), pa.array([int(met @ sizes)])], ["pairs", "products"])
                                continue
                            at, ball = np.nonzero(alive)
                        else:
                            at, ball = np.arange(len(q)), first
                        yield pa.RecordBatch.from_arrays([part["qid"].take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(balls[ball])],
                                                         ["qid", "dim", "ball"])

        return queries.mapInArrow(pairs, "pairs bigint, products bigint" if counted else "qid bigint, dim int, ball bigint")

    def lists(self, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """(qid, id, cosine, lot) of the best k in each cell that ``pairs`` (qid, dim, ball) lead to, none below the query's bar."""
        asked = pairs.groupBy("dim", "ball").agg(F.count("*").alias("nq"))
        blocks = lambda n: F.ceil(F.col(n) * F.col("dim") * 8 / BLOCK_BYTES).cast("int")
        cuts = materialize(self.sizes.join(asked, ["dim", "ball"]).select("dim", "ball", blocks("n").alias("nv"), blocks("nq").alias("nq")), "dense-cells")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        met = pairs.join(F.broadcast(cuts), ["dim", "ball"]).join(queries.select("qid", "qvec", "scope", "bar"), "qid")  # one row a ball
        left = met.withColumn("qb", part("qid", "nq")).withColumn("vb", every("nv"))
        right = self.rows.join(F.broadcast(cuts), ["dim", "ball"]).withColumn("vb", part("id", "nv")).withColumn("qb", every("nq"))
        cell = ["dim", "ball", "qb", "vb"]

        def score(key, q: pa.Table, v: pa.Table) -> pa.Table:
            best = Best(q["qid"].to_numpy(), matrix(q["qvec"]), q["scope"].to_pylist(), k)
            if len(q) and len(v):
                best.add(v["id"].to_numpy(), matrix(v["vec"]), v["key"].to_pylist())
            table = pa.Table.from_batches([best.table(q["bar"].combine_chunks().fill_null(-np.inf).to_numpy() - 1e-8)])
            lot = (key[1].as_py() * 31 + key[3].as_py()) % LOTS
            return table.append_column("lot", pa.array(np.full(len(table), lot, np.int32)))

        return left.select(*cell, "qid", "qvec", "scope", "bar").groupBy(*cell).cogroup(
            right.select(*cell, "id", "vec", "key").groupBy(*cell)).applyInArrow(score, OUT + ", lot int")


def merged(lists: DataFrame, k: int) -> DataFrame:
    """Best k of each query from its lists, those of a lot first."""
    place = F.row_number().over(W.partitionBy("qid", "lot").orderBy(F.desc("cosine"), "id"))
    cut = lists.withColumn("place", place).where(F.col("place") <= k).select("qid", "id", "cosine")
    return retriever_rank(cut, "cosine", "id", k)


def _scored_by_tile(queries: DataFrame, vectors: DataFrame, k: int, nq: int, n: int, dim: int) -> DataFrame:
    """(qid, id, cosine, lot): every query block against every vector block, one tile a task group.

    ``queries``: qid, qvec, scope, dim, bar. A query goes to as many tiles as there are vector blocks, and the other way round;
    blocks hold BLOCK_BYTES, so copies are few and a task's memory does not grow with the tables.
    """
    qbs, vbs = tile_blocks(nq, n, dim)
    every = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    part = lambda c, x: F.pmod(F.xxhash64(c), F.lit(x)).cast("int")
    left = queries.select("dim", part("qid", qbs).alias("qb"), every(vbs).alias("vb"), "qid", "qvec", "scope", "bar")
    right = vectors.select("dim", every(qbs).alias("qb"), part("id", vbs).alias("vb"), "id", "vec", "key")

    def score(key, q: pa.Table, v: pa.Table) -> pa.Table:
        best = Best(q["qid"].to_numpy(), matrix(q["qvec"]), q["scope"].to_pylist(), k, q["bar"].combine_chunks().fill_null(-np.inf).to_numpy() - 1e-8)
        if len(q) and len(v):
            best.add(v["id"].to_numpy(), matrix(v["vec"]), v["key"].to_pylist())
        table = pa.Table.from_batches([best.table()])
        return table.append_column("lot", pa.array(np.full(len(table), key[2].as_py() % LOTS, np.int32)))

    # Each tile is a partition of its own if it can be: tiles are few and long, and a task that draws two takes twice as long.
    cell, tiles = ["dim", "qb", "vb"], min(qbs * vbs * 2, TILE_TASKS)
    return left.repartition(tiles, *cell).groupBy(*cell).cogroup(right.repartition(tiles, *cell).groupBy(*cell)).applyInArrow(score, OUT + ", lot int")


def tile_blocks(nq: int, n: int, dim: int) -> tuple[int, int]:
    """Blocks of queries and of vectors: as large as BLOCK_BYTES allows, but no fewer than make some tiles."""
    return tuple(max(math.ceil(rows * dim * 8 / BLOCK_BYTES), min(TILES, rows), 1) for rows in (nq, n))


def _scored_by_ball(queries: DataFrame, vectors: DataFrame, k: int, n: int, nq: int, dim: int) -> DataFrame:
    dealt = DealtVectors(vectors, n)
    bare = queries.withColumn("bar", F.lit(None).cast("double"))
    first = materialize(dealt.lists(bare, dealt.reached(bare, False), k), "dense-first")
    bars = merged(first, k).where(F.col("rank") == k).select("qid", F.col("cosine").alias("bar"))
    barred = materialize(queries.join(bars, "qid", "left"), "dense-barred")
    # Where balls rule out too little, a query would be sent to most of them; tiles send fewer copies and multiply in fewer, larger pieces.
    pairs, products = dealt.meetings(barred)
    qbs, vbs = tile_blocks(nq, n, dim)
    if pairs > nq * vbs + n * qbs or products > nq * n * BALL_SHARE:
        return merged(_scored_by_tile(barred, dealt.rows, k, nq, n, dim), k)
    more = dealt.lists(barred, dealt.reached(barred, True), k)
    return merged(first.unionByName(more), k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(qid, id, cosine, rank): exact top k by cosine of unit vectors, ties by id.

    ``queries``: qid, qvec and optionally scope (array of keys, empty or absent = everything).
    ``vectors``: id, vec and optionally key (NULL = visible to every query).

    Vectors on either side that are null, empty, or hold a null or non-finite component take no part; a query meets the vectors
    of its own length only. ``limit``: bytes of query vectors that may be sent to all tasks.
    """
    q = queries.select("qid", "qvec", (F.col("scope") if "scope" in queries.columns else F.array()).cast("array<string>").alias("scope"),
                       F.size("qvec").alias("dim")).where(usable(F.col("qvec")))
    v = vectors.select("id", "vec", (F.col("key") if "key" in vectors.columns else F.lit(None)).cast("string").alias("key"),
                       F.size("vec").alias("dim")).where(usable(F.col("vec")))
    counted = q.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).head()
    fits = counted.n * counted.dim * 8 <= limit
    if fits and counted.n <= 2 * CENTRES:
        return retriever_rank(_scored_in_place(q.toArrow(), v, k), "cosine", "id", k)
    n = v.count()
    if fits and counted.n * counted.dim * n <= BALL_WORK:
        return retriever_rank(_scored_in_place(q.toArrow(), v, k), "cosine", "id", k)
    return _scored_by_ball(q, v, k, n, counted.n, counted.dim)


def retriever_rank(scored: DataFrame, score: str, tie: str, k: int = P.RRF_CANDIDATES) -> DataFrame:
    """1-based rank per query, cut at k."""
    w = W.partitionBy("qid").orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def confidence_flag(queries: DataFrame, top: DataFrame, threshold: float = P.MIN_DENSE_COSINE) -> DataFrame:
    """Best in-scope cosine per query (0 when its scope is empty) and whether it reaches the threshold."""
    best = top.where("rank = 1").select("qid", "cosine")
    return queries.select("qid").join(best, "qid", "left").select(
        "qid", F.coalesce("cosine", F.lit(0.0)).alias("best_cosine"),
        (F.coalesce("cosine", F.lit(0.0)) >= threshold).alias("confident"))


def mmr(queries: DataFrame, vectors: DataFrame, k: int, fetch: int = P.RRF_CANDIDATES, weight: float = 0.5) -> DataFrame:
    """(qid, id, pick): fetch by similarity, then pick k that are relevant and unlike the picks before.

    A query's group holds ``fetch`` candidates, so the greedy step runs on a bounded table.
    """
    hits = dense_topk(queries, vectors, fetch)
    full = hits.join(vectors.select("id", "vec"), "id").select("qid", "id", "cosine", "vec")

    def pick(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["id"].to_numpy(), -table["cosine"].to_numpy()))
        ids, sims = table["id"].to_numpy()[order], table["cosine"].to_numpy()[order]
        mat = matrix(table["vec"])[order]
        pair = np.round(mat @ mat.T, SCORE_DIGITS)
        chosen, left = [0], list(range(1, len(ids)))
        while left and len(chosen) < k:
            gain = [weight * sims[i] - (1 - weight) * pair[i, chosen].max() for i in left]
            chosen.append(left.pop(int(np.argmax(gain))))
        return pa.table({"qid": table["qid"].take(chosen), "id": pa.array(ids[chosen]),
                         "pick": pa.array(range(1, len(chosen) + 1), pa.int32())})

    return full.groupBy("qid").applyInArrow(pick, "qid bigint, id bigint, pick int")
