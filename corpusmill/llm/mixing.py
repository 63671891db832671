"""Mixing sources to target weights by fitting budgets as subset sums.

Every source gets a target number of words. Whole copies of the source fill it as far as they go; the rest, less than
one copy, is a subset-sum problem over documents. It is solved on counts of documents by exact size: each size class
first gives its proportional share, then a bounded knapsack closes the remaining gap, and the chosen number of
documents of each class is taken in seeded order. Only the (source, size) counts meet in one task per source: a source
of w words has at most sqrt(2w) different sizes, whatever its number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import n_words
from corpusmill.operators.dedupe import occurrence_no
from corpusmill.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Largest gap in words that the knapsack table covers; what remains above it is first filled with large documents.
TABLE_WORDS = 1 << 17
#: Sums that are listed singly where no table covers the gap; past them, one more sum for each part of the gap that has none.
MOST_SUMS = 1 << 19
#: Documents of one class that are put in order together; larger classes are ordered in seeded cells of about this size.
CELL_DOCS = 1000
#: Seeded places are whole numbers below this one.
DRAWS, LEAST = 2**52, -(2**63)


def targets(sizes: dict, total: float, weights=WEIGHTS, most: float = MOST_COPIES) -> dict:
    """Words for each source: ``total`` shared by weight, no source above ``most`` times its size, the excess shared
    again by weight among the others until none is above. ``sizes``: words by source name, None for no source. The rule for
    sizes in memory; ``target_table`` follows it for a table of any number of sources."""
    order = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, float(total), list(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def target_table(sources: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, number, target) of a table (source, source_size) with one row a source, by the rule of ``targets``.

    Sources are numbered in order of their names, null last, in ranges and not in one task. All sources below their limit have one
    level, words a unit of weight; each round adds up what the capped ones take and the weight of the others, and raises
    the level, until no other source is capped. A round is one sum over the table.
    """
    ordered = sources.select("source", "source_size", F.lit(0).alias("all"), F.struct(F.col("source").isNull().alias("none"), "source").alias("place"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("occurrence_no") % len(weights) + 1).cast("int"))
    rows = materialize(occurrence_no(ordered, ["all"], "place").select("source", "source_size", F.col("occurrence_no").alias("number"),
                                                                       weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "mix-sources")
    total, level, capped = int(rows.agg(F.sum("source_size")).head()[0] or 0), 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("cap")
        sums = rows.agg(F.sum(over.cast("int")).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).head()
        if (sums.n or 0) <= capped or not sums.weight:
            break
        capped, level = sums.n or 0, (total - (sums.taken or 0.0)) / sums.weight
    over = F.col("weight") * level > F.col("cap")
    return rows.select("source", "source_size", "number", F.when(over, F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def knapsack(sizes: np.ndarray, counts: np.ndarray, gap: int) -> np.ndarray:
    """How many of each size to take, at most ``counts``, so that the sum comes as near to ``gap`` as it can from below.

    Bounded knapsack over the sums 0 to ``gap``. Each sum remembers by which size, and how many of it, it was first
    reached, so the table is two arrays of ``gap`` numbers however many sizes there are.
    """
    taken = np.zeros(len(sizes), dtype=np.int64)
    by, many = np.full(gap + 1, -1, dtype=np.int32), np.zeros(gap + 1, dtype=np.int32)
    reached = np.zeros(gap + 1, dtype=bool)
    reached[0] = True
    for i in np.argsort(-sizes, kind="stable"):
        size, left = int(sizes[i]), int(counts[i])
        if not 0 < size <= gap or left <= 0:
            continue
        used = np.where(reached, 0, -1)
        part = 1
        while left > 0 and part * size <= gap:  # copies double (1, 2, 4 ...): the logarithm of the count
            part = min(part, left)
            jump = part * size
            new = np.flatnonzero((used[:-jump] >= 0) & (used[jump:] < 0)) + jump
            used[new] = used[new - jump] + part
            left -= part
            part *= 2
        new = np.flatnonzero((used > 0) & ~reached)
        by[new], many[new] = i, used[new]
        reached[new] = True
        if reached[gap]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = int(by[at]), int(many[at])
        taken[i] += n
        at -= n * int(sizes[i])
    return taken


def listed_knapsack(sizes: np.ndarray, counts: np.ndarray, gap: int) -> np.ndarray:
    """The same as ``knapsack`` on a list of the sums that are reached, for gaps of any length.

    Exact while at most MOST_SUMS sums are reached, as with few documents. Past that, new sums count only where their part of
    the gap, one of MOST_SUMS, has none yet.
    """
    taken = np.zeros(len(sizes), dtype=np.int64)
    sums, by, many = np.zeros(1, dtype=np.int64), np.full(1, -1, dtype=np.int32), np.zeros(1, dtype=np.int64)
    width = gap // MOST_SUMS + 1
    for i in np.argsort(-sizes, kind="stable"):
        size, left = int(sizes[i]), int(counts[i])
        if not 0 < size <= gap or left <= 0:
            continue
        used, part = np.zeros(len(sums), dtype=np.int64), 1
        while left > 0 and part * size <= gap:
            part = min(part, left)
            new = sums[:np.searchsorted(sums, gap - part * size, side="right")] + part * size
            at = np.minimum(np.searchsorted(sums, new), len(sums) - 1)
            fresh = np.flatnonzero(sums[at] != new)
            if len(sums) + len(fresh) > MOST_SUMS:
                _, first = np.unique(new[fresh] // width, return_index=True)
                fresh = fresh[first][~np.isin(new[fresh[first]] // width, sums // width)]
            n = used[fresh] + part
            sums = np.concatenate([sums, new[fresh]])
            order = np.argsort(sums, kind="stable")
            sums, used = sums[order], np.concatenate([used, n])[order]
            by = np.concatenate([by, np.full(len(fresh), i, dtype=np.int32)])[order]
            many = np.concatenate([many, n])[order]
            left -= part
            part *= 2
        if sums[-1] == gap:
            break
    at = len(sums) - 1
    while sums[at]:
        i, n = int(by[at]), int(many[at])
        taken[i] += n
        at = int(np.searchsorted(sums, sums[at] - n * int(sizes[i])))
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each size class so that their words come near ``budget``, below the words of all.

    Where proportional shares, large documents and the table don't meet the budget, the sums over what the shares leave are
    listed, then the sums over all documents; the nearest result is taken.
    """
    whole = int((sizes * counts).sum())
    if budget <= 0 or whole <= 0:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= whole:
        return counts.copy()
    share = (counts * (budget / whole)).astype(np.int64)
    taken, gap = share.copy(), budget - int((sizes * share).sum())
    # Large sizes first, until the knapsack table covers what is missing.
    for i in np.argsort(-sizes, kind="stable"):
        if gap <= TABLE_WORDS:
            break
        more = min(int(counts[i] - taken[i]), int(gap // sizes[i])) if sizes[i] else 0
        taken[i] += more
        gap -= more * int(sizes[i])
    best = taken + knapsack(sizes, counts - taken, min(gap, TABLE_WORDS))
    for base in (share, np.zeros_like(share)):
        if (sizes * best).sum() == budget:
            break
        more = base + listed_knapsack(sizes, counts - base, budget - int((sizes * base).sum()))
        gap = budget - int((sizes * more).sum())
        more += knapsack(sizes, counts - more, min(gap, TABLE_WORDS))
        if (sizes * more).sum() > (sizes * best).sum():
            best = more
    return best


PLAN = pa.schema([("source", pa.string()), ("size", pa.int64()), ("docs", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()),
                  ("copies", pa.int32()), ("extra", pa.int64())])


def planned_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans of the sources of a task, whose rows come sorted by source and size. One source at a time is held in whole."""
    def fitted(rows: pa.Table) -> pa.RecordBatch:
        sizes, docs = (rows[c].to_numpy().astype(np.int64) for c in ("size", "docs"))
        # Rows of several whole sources, each planned for itself.
        number = rows["number"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        copies, extra = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
        targets = rows["target"].to_numpy()
        for i, j in zip(starts, [*starts[1:], len(sizes)]):
            whole, target = int((sizes[i:j] * docs[i:j]).sum()), float(targets[i])
            times = min(MOST_COPIES, int(target // whole)) if whole else 0
            copies[i:j] = times
            if times < MOST_COPIES:
                extra[i:j] = fit(sizes[i:j], docs[i:j], int(round(target)) - times * whole)
        columns = [rows[c].combine_chunks() for c in PLAN.names[:5]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(copies), pa.array(extra)], schema=PLAN)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch["number"].to_numpy()
        if held and held[-1]["number"][-1].as_py() != number[0]:
            yield fitted(pa.Table.from_batches(held))
            held = []
        # Where the batch's last source begins; what stands before it is whole.
        cut = int(np.flatnonzero(number != number[-1])[-1]) + 1 if (number != number[-1]).any() else 0
        if cut:
            yield fitted(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield fitted(pa.Table.from_batches(held))


def plan(counts: DataFrame, source_targets: DataFrame) -> DataFrame:
    """One row for each (source, size): copies of every document and the number of documents that get one more."""
    # A null source is a group of its own.
    joined = counts.alias("c").join(source_targets.alias("t"), F.expr("c.source <=> t.source")).select(
        "c.*", "t.source_size", "t.target", "t.number")
    return joined.repartition("number").sortWithinPartitions("number", "size").mapInArrow(
        planned_sources, "source string, size bigint, docs bigint, source_size bigint, target double, copies int, extra bigint")


def mix(docs: DataFrame, seed: int = 7, size: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, any other columns) with size, source_size, target, copies and taken.

    ``taken`` is ``copies`` times the size: the words the mix takes of this row. Null and empty texts have size 0 and add
    nothing. A null source is a source, the last one. Repeated rows are rows of their own; which of several rows with
    equal doc_id, source and size are taken is not distinguishable, but only as many as the plan takes are. An empty table
    gives an empty table. Columns of the input with the names of the results are replaced. There may be any number of sources.

    Words are counted twice: once into a table of sizes, from which all is planned, and once with the result.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c not in made]
    sized = docs.select(*[F.col(f"`{c}`") for c in own], (n_words() if size is None else size).alias("size"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(DRAWS))
    narrow = materialize(sized.select("source", "size", "doc_id", draw.alias("draw")), "mix-sizes")
    counts = materialize(narrow.groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-counts")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    planned = materialize(plan(counts, target_table(sources)), "mix-plan")

    # The cut of a class is the place in seeded order of its last chosen document. It is found in cells of about
    # CELL_DOCS documents: counts tell the cell, and only that cell is put in order.
    open_ = planned.where((F.col("extra") > 0) & (F.col("extra") < F.col("docs")))
    drawn = (narrow.alias("d")
             .join(open_.alias("o"), same_class("d", "o"))
             .select("d.doc_id", "d.source", "d.size", "d.draw", "o.extra",
                     F.floor(F.col("d.draw") / DRAWS * F.ceil(F.col("o.docs") / CELL_DOCS)).alias("cell")))
    # Rows of one id count as one line, however many they are.
    ids = drawn.groupBy("source", "size", "cell", "draw", "doc_id").agg(F.count("*").alias("n"), F.first("extra").alias("extra"))
    cells = ids.groupBy("source", "size", "cell").agg(F.sum("n").alias("n"), F.first("extra").alias("extra"))
    upto = cells.withColumn("upto", F.sum("n").over(W.partitionBy("source", "size").orderBy("cell")))
    at = upto.where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("n") < F.col("extra"))).select(
        "source", "size", "cell", (F.col("extra") - F.col("upto") + F.col("n")).alias("nth"))
    cuts = (ids.alias("d").join(at.alias("a"), same_class("d", "a") & F.expr("d.cell = a.cell"))
            .select("d.source", "d.size", "d.draw", "d.doc_id", "d.n", "a.nth")
            .withColumn("place", F.sum("n").over(W.partitionBy("source", "size").orderBy("draw", "doc_id")))
            .where("place >= nth and place - n < nth")
            .select("source", "size", F.col("draw").alias("cut_draw"), F.col("doc_id").alias("cut_id"), F.col("n").alias("cut_rows"),
                    (F.col("nth") - F.col("place") + F.col("n")).alias("cut_taken")))
    classes = materialize(planned.alias("p").join(cuts.alias("c"), same_class("p", "c"), "left").select(
        "p.*", "c.cut_draw", "c.cut_id", "c.cut_rows", "c.cut_taken"), "mix-classes")
    one_more = F.when(F.col("c.extra") >= F.col("c.docs"), True).when(F.col("c.extra") == 0, False).otherwise(
        (F.col("draw") < F.col("c.cut_draw"))
        | ((F.col("draw") == F.col("c.cut_draw")) & (F.coalesce("d.doc_id", F.lit(LEAST)) <= F.coalesce("c.cut_id", F.lit(LEAST)))))

    def result(rows: DataFrame, more: Column) -> DataFrame:
        copies = F.col("c.copies") + F.when(more & (F.col("c.size") > 0), 1).otherwise(0)
        return rows.select(*[F.col(f"d.`{c}`") for c in own], "d.size", "c.source_size", "c.target", copies.alias("copies"),
                           (copies * F.col("d.size")).alias("taken"))

    rows = sized.withColumn("draw", draw).alias("d").join(classes.alias("c"), same_class("d", "c"))
    if not classes.where("cut_taken < cut_rows").limit(1).count():
        return result(rows, one_more)
    # Of the rows that repeat the id of the cut, as many as are left to take, by their number within the id.
    cut = F.coalesce(F.expr("c.cut_taken < c.cut_rows and draw = c.cut_draw and d.doc_id <=> c.cut_id"), F.lit(False))
    tied = rows.where(cut).select(F.struct("d.*").alias("d"), F.struct("c.*").alias("c"), F.col("d.source").alias("source"), F.col("d.size").alias("size"),
                                  F.monotonically_increasing_id().alias("row"))
    numbered = occurrence_no(tied, ["source", "size"], "row")
    return result(rows.where(~cut), one_more).unionByName(result(numbered, F.col("occurrence_no") < F.col("c.cut_taken")))


def same_class(a: str, b: str) -> Column:
    """Equal source and size, a null source being equal to itself."""
    return ((F.coalesce(F.col(f"{a}.source"), F.lit("")) == F.coalesce(F.col(f"{b}.source"), F.lit("")))
            & (F.col(f"{a}.source").isNull() == F.col(f"{b}.source").isNull()) & (F.col(f"{a}.size") == F.col(f"{b}.size")))
