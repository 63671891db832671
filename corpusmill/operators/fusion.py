"""Fusion of ranked lists and the hybrid retriever built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions.text import tokenize_terms
from corpusmill.operators import dense, lexical
from corpusmill.session import materialize

SCORE_DIGITS = 9


def rank_full_outer(lists: dict[str, DataFrame]) -> DataFrame:
    """(qid, id, <name>_rank ...): ranks side by side, NULL where a list lacks the item. One union and one grouping."""
    long = None
    for name, df in lists.items():
        one = df.select("qid", "id", F.lit(name).alias("src"), "rank")
        long = one if long is None else long.unionByName(one)
    return long.groupBy("qid", "id").agg(
        *[F.max(F.when(F.col("src") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists])


def rrf(weights: dict[str, float], k: int = P.RRF_K) -> Column:
    """Sum of weight / (k + rank) over the lists that hold the item."""
    parts = [F.coalesce(F.lit(w) / (k + F.col(f"{name}_rank")), F.lit(0.0)) for name, w in weights.items()]
    return F.round(sum(parts[1:], parts[0]), SCORE_DIGITS)


def rrf_fuse(lists: dict[str, DataFrame], weights: dict[str, float] | None = None,
             candidates: int = P.RRF_CANDIDATES) -> DataFrame:
    """Weighted reciprocal rank fusion of the top candidates of each list."""
    cut = {n: df.where(F.col("rank") <= candidates) for n, df in lists.items()}
    return rank_full_outer(cut).withColumn("fused", rrf(weights or P.RRF_WEIGHTS))


def protect_top1(fused: DataFrame, k: int) -> DataFrame:
    """Top k by fused score in which the first of every list keeps a place."""
    firsts = [F.coalesce(F.col(c) == 1, F.lit(False)) for c in fused.columns if c.endswith("_rank")]
    shield = firsts[0]
    for f in firsts[1:]:
        shield = shield | f
    by_place = W.partitionBy("qid").orderBy(F.desc("protected"), F.desc("fused"), "id")
    kept = fused.withColumn("protected", shield).withColumn("_p", F.row_number().over(by_place)).where(F.col("_p") <= k)
    final = W.partitionBy("qid").orderBy(F.desc("fused"), "id")
    return kept.withColumn("rank", F.row_number().over(final)).drop("_p")


def weighted_score_fuse(keyword: DataFrame, vector: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """The older fusion of scores: keyword score over its best, distance turned to similarity over the farthest.

    ``keyword``: qid, id, score, rank; ``vector``: qid, id, cosine, rank; both cut at 2k.
    """
    w = weights or P.SCORE_WEIGHTS
    per_query = W.partitionBy("qid")
    kw = keyword.where(F.col("rank") <= 2 * k).select("qid", "id", (
        F.col("score") / F.coalesce(F.nullif(F.max("score").over(per_query), F.lit(0.0)), F.lit(1.0)) * w["bm25"]).alias("s"))
    d = 2 - 2 * F.col("cosine")  # squared distance of unit vectors
    far = F.coalesce(F.nullif(F.max(d).over(per_query), F.lit(0.0)), F.lit(1.0))
    vec = vector.where(F.col("rank") <= 2 * k).select("qid", "id", ((1 - d / (far + 0.01)) * w["dense"]).alias("s"))
    summed = kw.unionByName(vec).groupBy("qid", "id").agg(F.round(F.sum("s"), SCORE_DIGITS).alias("score"))
    return dense.retriever_rank(summed, "score", "id", k)


MODES = ("hybrid", "dense", "bm25")


def hybrid_retrieve(queries: DataFrame, chunks: DataFrame, k: int = P.RETRIEVAL_K, mode: str = "hybrid",
                    use_scope: bool = True, strip_names: bool = False, counts: DataFrame | None = None,
                    texts: DataFrame | None = None) -> DataFrame:
    """Top k chunks per query with score, cosine and both ranks (hybrid only: a rank is null where a list lacks the chunk),
    and for the query the best cosine in scope and whether it reaches the threshold.

    ``queries``: qid, text, stripped, scope, qvec. ``chunks``: id, terms, vec, key; or ``texts`` has id, terms, key for the
    keyword search, so that terms need not go through the join that gives chunks their vectors.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    scope = F.col("scope") if use_scope else F.array().cast("array<string>")
    asked = F.col("stripped") if use_scope and strip_names else F.col("text")
    q = queries.select("qid", scope.alias("scope"), "qvec", tokenize_terms(asked).alias("terms"))
    depth = max(k, P.RRF_CANDIDATES)
    vec = dense.dense_topk(q.select("qid", "qvec", "scope"), chunks.select("id", "vec", "key"), depth)
    if mode == "dense":
        return judged(vec.where(F.col("rank") <= k).select("qid", "id", F.col("cosine").alias("score"), "rank"), vec, queries, chunks)
    texts = chunks if texts is None else texts
    kw = lexical.bm25_topk(q.select("qid", "terms", "scope"), texts.select("id", "terms", "key"), depth, counts)
    if mode == "bm25":
        return judged(kw.where(F.col("rank") <= k).select("qid", "id", "score", "rank"), vec, queries, chunks)
    top = protect_top1(rrf_fuse({"dense": vec, "bm25": kw}), k)
    return judged(top.select("qid", "id", F.col("fused").alias("score"), "rank", "dense_rank", "bm25_rank"), vec, queries, chunks)


def judged(top: DataFrame, vec: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``top`` with the cosine of each hit and the query's best cosine. k rows a query meet the vectors of their own ids."""
    pairs = top.join(chunks.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
    dot = F.aggregate(F.zip_with("vec", "qvec", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    best = vec.where(F.col("rank") == 1).select("qid", F.col("cosine").alias("best_cosine"))
    told = pairs.select("qid", "id", *[c for c in top.columns if c not in ("qid", "id")], F.round(dot, SCORE_DIGITS).alias("cosine")).join(best, "qid", "left")
    return told.withColumn("best_cosine", F.coalesce("best_cosine", F.lit(0.0))).withColumn(
        "confident", F.col("best_cosine") >= P.MIN_DENSE_COSINE)


SWEEP = {
    "dense only": ("dense", 0), "bm25 only": ("bm25", 0), "hybrid": ("hybrid", 0),
    "dense + scope": ("dense", 1), "bm25 + scope + strip": ("bm25", 2), "hybrid + scope + strip": ("hybrid", 2),
    "bm25 + scope": ("bm25", 1), "hybrid + scope": ("hybrid", 1),
}


def config_sweep(queries: DataFrame, chunks: DataFrame, k: int = P.RETRIEVAL_K, texts: DataFrame | None = None) -> DataFrame:
    """(config, qid, id, rank) for the eight configurations of mode, scope and name stripping.

    The distinct searches behind them run once: keyword search over three variants of each query (plain, scoped,
    scoped and stripped), vector search over two. ``texts``: as of ``hybrid_retrieve``. Their short result lists are written out and read by all eight.
    """
    none = F.array().cast("array<string>")
    variants = F.explode(F.array(
        F.struct(F.lit(0).alias("v"), none.alias("scope"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("v"), F.col("_scope").alias("scope"), F.col("text").alias("t")),
        F.struct(F.lit(2).alias("v"), F.col("_scope").alias("scope"), F.col("stripped").alias("t"))))
    asked = queries.withColumnRenamed("scope", "_scope").select("qid", "qvec", "text", "stripped", "_scope", variants.alias("x")).select(
        (F.col("qid") * 3 + F.col("x.v")).alias("qid"), "qvec", "x.scope", tokenize_terms(F.col("x.t")).alias("terms"), F.col("x.v").alias("v"))
    depth = max(k, P.RRF_CANDIDATES)
    texts = chunks if texts is None else texts
    kw = materialize(lexical.bm25_topk(asked.select("qid", "terms", "scope"), texts.select("id", "terms", "key"), depth), "sweep-bm25")
    vec = materialize(dense.dense_topk(asked.where("v < 2").select("qid", "qvec", "scope"), chunks.select("id", "vec", "key"), depth), "sweep-dense")
    all_vec = vec.unionByName(vec.where("qid % 3 = 1").withColumn("qid", F.col("qid") + 1))
    lists = {"dense": vec, "bm25": kw, "hybrid": protect_top1(rrf_fuse({"dense": all_vec, "bm25": kw}), k)}
    labels = F.create_map(*[F.lit(x) for name, (mode, v) in SWEEP.items() for x in (f"{mode}{v}", name)])
    out = None
    for mode, df in lists.items():
        one = df.where(F.col("rank") <= k).select(
            F.try_element_at(labels, F.concat(F.lit(mode), (F.col("qid") % 3).cast("string"))).alias("config"),
            F.floor(F.col("qid") / 3).alias("qid"), "id", "rank")
        out = one if out is None else out.unionByName(one)
    return out
