"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The turns that both sides share from the start are rendered once, as the prompt; what follows on each side is its
completion, with the ranges that count for the loss: the words of the assistant. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turns rendered into one row. Longer conversations continue in further rows, so no row or group grows without bound.
SEGMENT_TURNS = 256
TRAINED = "assistant"
HEAD, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
OUT = ["pair_id", "segment", "n_common", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]


def header(role: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(BREAK))


def rendered(turns: Column) -> Column:
    """Turns in order as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), t["text"], F.lit(END))), "")


def mask(turns: Column, begin_at: Column) -> Column:
    """start:end of what the assistant says, in characters of the rendered text, which begins at ``begin_at``; end exclusive,
    comma-joined. The end sign of such a turn counts, its header doesn't."""
    def step(have: Column, t: Column) -> Column:
        start = have["at"] + F.length(header(t["role"]))
        end = start + F.length(t["text"]) + len(END) - 1
        return F.struct((end + 1).alias("at"), F.when(t["role"] == TRAINED, F.array_append(
            have["ranges"], F.concat_ws(":", start, end))).otherwise(have["ranges"]).alias("ranges"))
    begin = F.struct(begin_at.alias("at"), F.array().cast("array<string>").alias("ranges"))
    return F.aggregate(turns, begin, step, lambda have: F.array_join(have["ranges"], ","))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Rows (pair_id, segment, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask).

    Both sides: pair_id, turn, role, text. Turns are matched by their number; the prompt is all turns below the first
    number at which role or text differ or one side has no turn. A null role is ``unknown``, a null text empty; rows with a
    null pair_id or turn are left out. Of rows that repeat a number on one side the smallest (role, text) counts. A pair
    with one side only has an empty prompt and an empty other side; equal sides have empty completions; an empty table
    gives an empty one. Segment s holds the turns whose number divided by ``segment_turns`` is s, so a pair has one row
    unless it is longer. n_common is the pair's number of common turns on each of its rows, and masks count from the start of
    the pair's whole completion, so its parts are joined by putting texts and masks one behind the other in order of
    segment (``whole_pairs``). Further columns don't matter.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        said = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        other = F.lit(None).cast("struct<role:string,text:string>")
        rows = df.where("pair_id is not null and turn is not null")
        return rows.select("pair_id", F.col("turn").cast("long").alias("turn"), (said if name == "c" else other).alias("c"),
                           (said if name == "r" else other).alias("r"))

    turns = side(chosen, "c").unionByName(side(rejected, "r")).groupBy("pair_id", "turn").agg(F.min("c").alias("c"), F.min("r").alias("r"))
    turns = turns.withColumn("segment", F.floor(F.col("turn") / segment_turns))
    # What a segment must know of its pair, from numbers alone: the first turn that differs, how many turns come before it, and
    # where its own completions begin. A segment's numbers are at most as many as it has turns; a join brings the result
    # back, and a pair of very many turns is split by the adaptive skew join.
    long = {s: F.when(F.col(s).isNotNull(), F.length(header(F.col(f"{s}.role"))) + F.length(f"{s}.text") + len(END)).otherwise(0) for s in ("c", "r")}
    numbers = turns.select("pair_id", "segment", F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn")).alias("differs"),
                           F.struct("turn", long["c"].alias("c"), long["r"].alias("r")).alias("x")).groupBy("pair_id", "segment").agg(
        F.min("differs").alias("first"), F.collect_list("x").alias("x"))
    pair = W.partitionBy("pair_id")
    before = pair.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    numbers = numbers.withColumn("first", F.min("first").over(pair))
    alone = F.filter("x", lambda x: x["turn"] >= F.col("first"))
    chars = {s: F.aggregate(alone, F.lit(0).cast("long"), lambda n, x: n + x[s]) for s in ("c", "r")}  # noqa: B023
    begins = numbers.select("pair_id", "segment", "first", F.size(F.filter("x", lambda x: F.col("first").isNull() | (x["turn"] < F.col("first")))).alias("n"),
                            *[F.when(F.col("first").isNull(), 0).otherwise(n).alias(f"{s}_chars") for s, n in chars.items()]).select(
        "pair_id", "segment", "first", F.sum("n").over(pair).alias("n_common"),
        *[F.coalesce(F.sum(f"{s}_chars").over(before), F.lit(0)).alias(f"{s}_at") for s in ("c", "r")])
    held = turns.join(begins, ["pair_id", "segment"]).withColumn("shared", F.col("first").isNull() | (F.col("turn") < F.col("first")))

    def part(said: str, when: Column) -> Column:
        t = F.struct("turn", F.col(f"{said}.role").alias("role"), F.col(f"{said}.text").alias("text"))
        return F.array_sort(F.collect_list(F.when(when & F.col(said).isNotNull(), t)))

    parts = held.groupBy("pair_id", "segment").agg(
        *[F.first(c).alias(c) for c in ("n_common", "c_at", "r_at")], part("c", F.col("shared")).alias("p"),
        part("c", ~F.col("shared")).alias("c"), part("r", ~F.col("shared")).alias("r"))
    return parts.select(
        "pair_id", "segment", "n_common", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"),
        mask(F.col("c"), F.col("c_at")).alias("chosen_mask"), rendered(F.col("r")).alias("rejected"), mask(F.col("r"), F.col("r_at")).alias("rejected_mask"))


def whole_pairs(parts: DataFrame) -> DataFrame:
    """One row for each pair of ``preference_pairs``, whatever its length: its segments joined, which a row must then hold whole."""
    texts = ["prompt", "chosen", "rejected"]
    masks = ["chosen_mask", "rejected_mask"]
    joined = parts.groupBy("pair_id", "n_common").agg(F.array_sort(F.collect_list(F.struct("segment", *texts, *masks))).alias("s"))
    every = lambda c: F.transform("s", lambda x: x[c])
    return joined.select("pair_id", "n_common", *[F.array_join(every(c), "").alias(c) for c in texts],
                         *[F.array_join(F.filter(every(c), lambda x: x != ""), ",").alias(c) for c in masks])


def with_first_reply(conversations: DataFrame) -> DataFrame:
    """A rejected side for conversations (conv_id, turn, role, text) that have none: the last reply of the assistant is
    replaced by its first one, or by an empty one where there is no other."""
    by = conversations.where(F.col("role") == TRAINED).groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.min_by("text", F.struct("turn", "text")).alias("reply"), F.min("turn").alias("earliest"))
    told = conversations.join(by, "conv_id", "left")
    text = F.when((F.col("role") == TRAINED) & (F.col("turn") == F.col("last")),
                  F.when(F.col("earliest") < F.col("last"), F.col("reply")).otherwise("")).otherwise(F.col("text"))
    return told.select("conv_id", "turn", "role", text.alias("text"))
