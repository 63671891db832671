"""What the operators of this folder share: bounded Arrow batches and the word rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that one Arrow batch may hold; a single longer text still travels whole, alone in its batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 * 1024 * 1024


def bounded(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small, so that a Python worker's memory depends on the longest text and not on the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{folder}/{name}.parquet")


def append(df: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """``df`` with the fields ``names`` of the struct ``made``; a column that has one of these names already is replaced."""
    kept = [c for c in df.columns if c not in names]
    held = "_made"
    while held in kept:
        held += "_"
    rows = df.select(*[F.col(f"`{c}`") for c in kept], made.alias(held))
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{held}.{n}").alias(n) for n in names])


def others(df: DataFrame, names: list[str]) -> Column:
    """All columns of ``df`` but those called ``names`` (in any case) as one struct."""
    lowered = {n.lower() for n in names}
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered])


def n_words(text: str = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def chance(*cols: Column | str) -> Column:
    """A reproducible number below 2^31 for seeded choices."""
    return F.pmod(F.xxhash64(*cols), F.lit(2**31))
