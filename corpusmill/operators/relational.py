"""Joins, aggregates, windows, top-k and set operations in the shape the corpus jobs need them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions.text import extract_numbers
from corpusmill.operators.dedupe import occurrence_no
from corpusmill.session import materialize


# ---- joins ----

def fact_dim_join(fact: DataFrame, dim: DataFrame, on: str, keys: DataFrame | None = None) -> DataFrame:
    """Inner join of a fact table with its dimension, the key list applied to the fact side before the join."""
    if keys is not None:
        fact = fact.join(keys.select(on), on, "left_semi")
    return fact.join(dim, on)


def provenance_join(records: DataFrame, manifest: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Records with the manifest's columns, NULL where the manifest does not know them."""
    return records.join(manifest.select(on, *columns), on, "left")


def missing_reference(df: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    """Rows without a partner; also the foreign-key check of the fact tables."""
    return df.join(reference.select(on), on, "left_anti")


def attach_vectors(chunks: DataFrame, vectors: DataFrame, on: str) -> DataFrame:
    """Chunks with their vectors; what either side lacks stays visible as ``status``."""
    both = chunks.withColumn("_c", F.lit(1)).join(vectors.withColumn("_v", F.lit(1)), on, "full_outer")
    status = F.when(F.col("_v").isNull(), "no vector").when(F.col("_c").isNull(), "no text").otherwise("ok")
    return both.withColumn("status", status).drop("_c", "_v")


def in_scope(ids: Column, key: Column) -> Column:
    """Visible when the chunk is general knowledge, its key is asked for, or the query names nothing."""
    return key.isNull() | (F.size(ids) <= 0) | F.coalesce(F.array_contains(ids, key), F.lit(False))


def scope_join(queries: DataFrame, chunks: DataFrame, qid: str, ids: str, key: str, aggs: dict[str, tuple]) -> DataFrame:
    """Aggregates over the chunks each query may see, without building one query-chunk pair.

    Chunks are reduced to one row per scope key (general knowledge is its own key, ``all`` the total); each query then
    meets only the keys it may see by equi-join. ``aggs``: name -> (first step, merge step), both functions of a column.
    """
    first = [step(c).alias(name) for name, (step, _, c) in aggs.items()]
    by_key = chunks.groupBy(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("general")).alias("_k")).agg(*first)
    total = by_key.agg(*[merge(F.col(n)).alias(n) for n, (_, merge, _) in aggs.items()]).select(F.lit("all").alias("_k"), "*")
    wanted = F.when(F.size(ids) <= 0, F.array(F.lit("all"))).otherwise(F.array_distinct(F.concat(
        F.array(F.lit("general")), F.transform(ids, lambda i: F.concat(F.lit("="), i.cast("string"))))))
    asked = queries.select(qid, F.explode(wanted).alias("_k"))
    return asked.join(by_key.unionByName(total), "_k").groupBy(qid).agg(
        *[merge(F.col(n)).alias(n) for n, (_, merge, _) in aggs.items()])


def pattern_label(hits: DataFrame, patterns: DataFrame, on: str, text: Column, pattern: str) -> DataFrame:
    """Hits with ``relevant``: the query's own pattern found in the hit, case ignored."""
    return hits.join(patterns, on).withColumn(
        "relevant", F.regexp_like(text, F.concat(F.lit("(?iU)"), F.col(pattern))))


def all_patterns(text: Column, patterns: Column) -> Column:
    return F.forall(patterns, lambda p: F.regexp_like(text, F.concat(F.lit("(?iU)"), p)))


# ---- aggregates ----

def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def size_stats_by(df: DataFrame, key: str, size: Column) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.min(size).cast("bigint").alias("min_size"),
        F.floor(F.avg(size)).cast("bigint").alias("avg_size"), F.max(size).cast("bigint").alias("max_size"))


def elements_at(df: DataFrame, value: Column, ranks: Callable[[int], dict[str, int]]) -> DataFrame:
    """One row with the elements of a column at given places of its order, exact; ``ranks`` names the places, from the number of
    values (nulls don't count). Null where there is no such place.

    The histogram of values is dealt into ranges and each range is counted; only the ranges that hold a place are put in
    order, each for itself, so no task orders all values however many different ones there are.
    """
    hist = df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("c"))
    cells = materialize(hist.repartitionByRange("v").withColumn("cell", F.spark_partition_id()), "value-cells")
    sizes = cells.groupBy("cell").agg(F.sum("c").alias("n")).orderBy("cell").collect()  # one row a range
    ends = list(accumulate(r.n for r in sizes))
    places = {}
    for name, rank in ranks(ends[-1] if ends else 0).items():
        at = bisect_right(ends, rank)
        places[name] = (sizes[at].cell, rank - (ends[at - 1] if at else 0)) if 0 <= rank and at < len(ends) else (-1, 0)
    running = W.partitionBy("cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    cum = cells.where(F.col("cell").isin(sorted({cell for cell, _ in places.values()}))).withColumn("hi", F.sum("c").over(running))
    return cum.agg(*[F.min(F.when((F.col("cell") == cell) & (F.col("hi") > at), F.col("v"))).alias(name) for name, (cell, at) in places.items()])


def ranked_elements(df: DataFrame, value: Column, **shares: tuple[int, int]) -> DataFrame:
    """Elements ``sorted[n * a // b]`` of a column, exact."""
    return elements_at(df, value, lambda n: {name: n * a // b for name, (a, b) in shares.items()})


def distribution_stats(df: DataFrame, tokens: Column, group: str, price_per_million: float) -> DataFrame:
    """Min, upper median, max and sum of sizes, documents with more than one piece, cost, and the describe columns."""
    sized = df.select(group, tokens.cast("bigint").alias("v"))
    split = sized.groupBy(group).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n_split"))
    basic = sized.agg(
        F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("total"),
        F.round(F.sum("v") / 1e6 * price_per_million, 6).alias("cost"), F.round(F.avg("v"), 6).alias("mean"),
        F.round(F.stddev("v"), 6).alias("std"))
    quarters = (50, 75, 90, 95)
    # A percentile lies between two neighbours of the order.
    found = elements_at(sized, F.col("v"), lambda n: {"median": n // 2} | {
        f"{side}{q}": ((n - 1) * q + up) // 100 for q in quarters for side, up in (("lo", 0), ("hi", 99))})
    values = found.select(F.struct(*found.columns)).scalar()
    told = basic.select("*", values.alias("_e"), split.scalar().alias("n_split"))
    share = lambda q: ((F.col("n") - 1) * q % 100) / 100
    return told.select(*basic.columns, *[F.round(F.col(f"_e.lo{q}") * (1 - share(q)) + F.col(f"_e.hi{q}") * share(q), 6).alias(f"p{q}") for q in quarters],
                       F.col("_e.median").alias("median"), "n_split")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def ordered_string_agg(df: DataFrame, key: str, value: str, order: list[str], separator: str = ", ") -> DataFrame:
    """Values of a key joined in order. The whole group becomes one text, so this is for child lists that are short
    by nature (the managers of a scheme), not for keys that grow with the data.
    """
    by = ", ".join(f"`{o}`" for o in order)
    return df.groupBy(key).agg(F.expr(f"listagg(`{value}`, '{separator}') WITHIN GROUP (ORDER BY {by})").alias("joined"))


def failure_rate_gate(df: DataFrame, reason: Column, limit: float = P.MAX_FAILURE_RATE) -> DataFrame:
    """Entries, failures (neither duplicate nor dead page), rate and whether the run may be published."""
    failed = reason.isNotNull() & ~reason.isin("duplicate", "dead page")
    return df.agg(
        F.count("*").alias("entries"), F.count_if(failed).alias("failures"), F.count_if(reason == "duplicate").alias("duplicates"),
        F.count_if(reason == "dead page").alias("dead")).select(
        "*", F.round(F.col("failures") / F.col("entries"), 6).alias("rate"),
        (F.col("failures") / F.col("entries") <= limit).alias("passed"))


def source_rollup(df: DataFrame, url: str, order: str, first: list[str]) -> DataFrame:
    """One row per source: the first record's columns and the number of documents."""
    head = F.min_by(F.struct(*first), order).alias("_f")
    return df.groupBy(url).agg(head, F.count("*").alias("documents")).select(url, "_f.*", "documents")


def accuracy_by_class(df: DataFrame, expected: str, got: str) -> DataFrame:
    """Correct and total per expected class and overall (class ``(all)``)."""
    ok = F.coalesce(F.col(expected) == F.col(got), F.lit(False))
    return df.withColumn("_ok", ok.cast("int")).rollup(expected).agg(
        F.sum("_ok").alias("correct"), F.count("*").alias("total"), F.grouping(expected).alias("_all")).select(
        F.when(F.col("_all") == 1, "(all)").otherwise(F.col(expected).cast("string")).alias("expected"), "correct", "total",
        F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"))


def metric_means(df: DataFrame, group: str, *metrics: str) -> DataFrame:
    """Means and row counts per group and over all rows (group ``MEAN``), rounded to six digits."""
    return df.rollup(group).agg(
        *[F.round(F.avg(m), 6).alias(m) for m in metrics], F.count("*").alias("n"), F.grouping(group).alias("_all")).select(
        F.when(F.col("_all") == 1, "MEAN").otherwise(F.col(group)).alias(group), *metrics, "n")


def multiset_match(got: DataFrame, expected: DataFrame, key: str, label: str) -> DataFrame:
    """Per key: are the labels equal as multisets, and as sets? Compared by counts, no list is ever built."""
    both = got.select(key, label, F.lit(1).alias("g"), F.lit(0).alias("e")).unionAll(
        expected.select(key, label, F.lit(0), F.lit(1)))
    sums = both.groupBy(key, label).agg(F.sum("g").alias("g"), F.sum("e").alias("e"))
    return sums.groupBy(key).agg(F.bool_and(F.col("g") == F.col("e")).alias("same_multiset"),
                                 F.bool_and((F.col("g") > 0) == (F.col("e") > 0)).alias("same_set"))


# ---- windows and top-k ----

def topn_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group; Spark cuts every partition to n per group before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def previous_rows(df: DataFrame, key: str, order: str, value: Column, n: int, width: int = 100_000) -> DataFrame:
    """Array ``previous`` of the values of up to n rows before each row of its key.

    Rows are numbered per key and dealt into cells of ``width`` rows; each cell also gets the last n rows of the cell
    before it as context, so no task holds one long key whole.
    """
    numbered = occurrence_no(df.withColumn("_v", value), [key], order)
    rn = F.col("occurrence_no")
    home = F.expr(f"occurrence_no div {width}")
    cells = F.when(rn % width >= width - n, F.array(home, home + 1)).otherwise(F.array(home))
    dealt = numbered.withColumn("_cell", F.explode(cells))
    w = W.partitionBy(key, "_cell").orderBy("occurrence_no").rowsBetween(-n, -1)
    return (dealt.withColumn("previous", F.collect_list("_v").over(w))
            .where(F.col("_cell") == home).drop("_cell", "_v", "occurrence_no"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Question and answer of each exchange: a user turn and the assistant turn right after it."""
    q = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                         F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


def last_n_turns(pairs: DataFrame, n: int = P.HISTORY_TURNS, chars: int = P.HISTORY_ANSWER_CHARS) -> DataFrame:
    """Each exchange with the transcript of up to n exchanges before it."""
    shown = F.concat(F.lit("User: "), F.col("question"), F.lit("\nAssistant: "), F.left("answer", F.lit(chars)))
    out = previous_rows(pairs, "conv_id", "turn", shown, n)
    return out.withColumn("transcript", F.array_join("previous", "\n")).withColumn("n_turns", F.size("previous")).drop("previous")


def preview(df: DataFrame, order: str, n: int) -> DataFrame:
    """First n rows and the row count of the whole table."""
    total = df.agg(F.count("*").alias("row_count"))
    return df.orderBy(order).limit(n).select("*", total.scalar().alias("row_count"))


# ---- sets ----

def union_documents(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def ungrounded_values(answers: DataFrame, sources: DataFrame, key: str, answer: str, source: str) -> DataFrame:
    """Distinct numbers of an answer that none of its sources contains."""
    said = answers.select(key, F.explode(extract_numbers(F.col(answer))).alias("number")).distinct()
    known = sources.select(key, F.explode(extract_numbers(F.col(source))).alias("number"))
    return said.join(known, [key, "number"], "left_anti")
