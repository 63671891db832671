"""Retrieval and answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.operators.relational import ranked_elements
from corpusmill.session import materialize


def retrieval_metrics(queries: DataFrame, hits: DataFrame, relevant: Column, *config: str) -> DataFrame:
    """hit@1/3/5 and MRR per configuration; a query without a correct hit contributes zero.

    ``queries`` holds every (configuration, qid); ``hits`` their ranked results.
    """
    keys = [*config, "qid"]
    first = hits.where(relevant).groupBy(*keys).agg(F.min("rank").alias("first"))
    share = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6)
    return queries.select(*keys).join(first, keys, "left").groupBy(*config).agg(
        F.count("*").alias("n"), share(1).alias("hit_1"), share(3).alias("hit_3"), share(5).alias("hit_5"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def threshold_calibration(best: DataFrame, threshold: float = P.MIN_DENSE_COSINE, show: int = 4) -> DataFrame:
    """One row: wrongly refused and wrongly accepted questions, spread of in-scope scores, highest off-topic scores.

    ``best``: qid, best_cosine (rounded by the search, one per question), off_topic.
    """
    best = materialize(best, "best-cosine")  # the search behind it runs once
    inside, off = best.where(~F.col("off_topic")), best.where("off_topic")
    counts = best.agg(
        F.count_if(~F.col("off_topic")).alias("n_in_scope"), F.count_if("off_topic").alias("n_off_topic"),
        F.count_if(~F.col("off_topic") & (F.col("best_cosine") < threshold)).alias("refused"),
        F.count_if(F.col("off_topic") & (F.col("best_cosine") >= threshold)).alias("accepted"))
    spread = ranked_elements(inside, F.col("best_cosine"), low=(0, 1), p10=(1, 10), median=(1, 2))
    top = off.orderBy(F.desc("best_cosine"), "qid").limit(show).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("best_cosine")).alias("c"), "qid"))),
        lambda x: x["qid"].cast("string")), ",").alias("top_off_topic"))
    order = spread.select(F.struct("low", "p10", "median")).scalar()
    return counts.select("*", order.alias("_o"), top.scalar().alias("top_off_topic")).select(
        *counts.columns, "_o.*", "top_off_topic")


def judge_scorecard(rows: DataFrame, answered: Column, **flags: Column) -> DataFrame:
    """Sums of verdict flags over answered rows, and how many were declined."""
    return rows.agg(
        F.count("*").alias("n"), F.count_if(answered).alias("answered"), F.count_if(~answered).alias("declined"),
        *[F.count_if(answered & flag).alias(name) for name, flag in flags.items()])
