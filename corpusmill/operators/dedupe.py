"""First of equal records, occurrence numbers and latest records, safe when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.session import materialize


def key_hash(keys: list[Column]) -> Column:
    """Fixed-width stand-in for a composite key; the text itself never travels through a shuffle."""
    parts = [F.coalesce(F.concat(F.lit("+"), k.cast("string")), F.lit("-")) for k in keys]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def flag_duplicates(df: DataFrame, keys: list[Column], row_id: str, applies: Column | None = None) -> DataFrame:
    """Add ``duplicate``: false for the record with the lowest ``row_id`` of its key.

    The lowest id per key is a grouped minimum (combined before the shuffle), and it is joined back on the unique
    ``row_id``, so a key that a third of all rows share meets no single task.
    """
    applies = F.lit(True) if applies is None else applies
    firsts = (df.where(applies).select(key_hash(keys).alias("k"), row_id).groupBy("k")
              .agg(F.min(row_id).alias(row_id)).select(row_id, F.lit(True).alias("_first")))
    return (df.withColumn("_applies", applies).join(firsts, row_id, "left")
            .withColumn("duplicate", F.col("_applies") & F.col("_first").isNull()).drop("_applies", "_first"))


def dedupe_first(df: DataFrame, keys: list[Column], row_id: str) -> DataFrame:
    return flag_duplicates(df, keys, row_id).where(~F.col("duplicate")).drop("duplicate")


def key_cells(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``_cell``: the number of the range of (keys, order) that a row falls in.

    Ranges are cut by sampled row counts, so they hold about equally many rows whatever the ids look like, and a key with
    most rows spans many of them. The table is written, so every reader sees the same cells.
    """
    ranged = df.repartitionByRange(*[F.col(f"`{c}`") for c in [*keys, order]])
    return materialize(ranged.withColumn("_cell", F.spark_partition_id()), "cells")


def occurrence_no(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """0-based number of each row within its key, in order of a unique column.

    Rows are numbered inside (key, cell) and shifted by the sizes of the earlier cells of the key, so no task sorts a whole
    hot key, and sparse or hash-like ids don't matter.
    """
    split = key_cells(df, keys, order)
    sizes = split.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_cell").orderBy(order)
    numbered = split.withColumn("_rn", F.row_number().over(inside))
    on = [numbered[k].eqNullSafe(starts[k]) for k in [*keys, "_cell"]]
    return (numbered.join(starts, on).select(*[numbered[c] for c in df.columns],
                                             (F.col("_start") + F.col("_rn") - 1).alias("occurrence_no")))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the highest order value per key, as one grouped maximum over the packed row."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add or replace records by key; on equal order the new record wins."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return latest(both, keys, [order, "_src"]).drop("_src")
