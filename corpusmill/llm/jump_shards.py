"""Sharding by jump consistent hashing.

A stable key alone tells the shard among any number of shards: the key seeds a sequence of jumps to ever larger shard
numbers, and the last one below the number of shards is taken. There is no table of shards; with one more shard a key
either stays or goes to the new one, so appending shards moves the least possible part of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded, others
from corpusmill.operators.dedupe import occurrence_no
from corpusmill.session import materialize

SHARDS = 16
LAW = "key"
MADE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. All keys jump together; those that are past the last shard drop out."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    at, left = np.zeros(len(state), np.int64), np.arange(len(state))
    while len(left):
        state = state * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        to = ((at[left] + 1) * step).astype(np.int64)
        inside = to < shards
        left, state = left[inside], state[inside]
        at[left] = to[inside]
    return at.astype(np.int32)


def stable_key(*columns: Column) -> Column:
    """60 bits of the digest of the columns as text: the same in every session, whatever the type of an id. A null is a
    value of its own."""
    parts = [F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """Shard number, 0 to ``shards`` - 1, of a 64-bit key."""
    @F.pandas_udf("int")
    def dealt(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump(keys.to_numpy(np.int64), shards))

    return dealt(key)


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """``docs`` with shard and grown_shard, the shard with one more of them. Rows stay where they are.

    Rows with one key share a shard, rows with a null key too; texts don't matter. Columns with these names are replaced.
    """
    bounded(docs.sparkSession)
    rows = docs.select(others(docs, ["shard", "grown_shard"]).alias("d"), stable_key(F.col(f"`{key}`")).alias("k"))
    return rows.select("d.*", shard_of(F.col("k"), shards).alias("shard"), shard_of(F.col("k"), shards + 1).alias("grown_shard"))


def moves(docs: DataFrame, before: int, after: int, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that change their shard when ``before`` shards become ``after``, with old_shard and new_shard. What
    stays needn't be read again."""
    bounded(docs.sparkSession)
    rows = docs.select(others(docs, ["old_shard", "new_shard"]).alias("d"), stable_key(F.col(f"`{key}`")).alias("k"))
    both = rows.select("d", shard_of(F.col("k"), before).alias("a"), shard_of(F.col("k"), after).alias("b"))
    return both.where("a <> b").select("d.*", F.col("a").alias("old_shard"), F.col("b").alias("new_shard"))


def manifest(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: the key, size, text_crc32, law, shard, slot and grown_shard.

    size: UTF-8 bytes of the text plus one, a null text having none; text_crc32 is that of the empty text then. slot numbers the
    rows of a shard from 0 by key (null first), size and checksum. It is counted in ranges of shard, key and row, so neither a
    shard nor a key that most rows repeat meets in one task. Repeated rows have slots of their own; an empty table gives an
    empty one; further columns don't matter.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = materialize(assign(narrow, shards, "key").withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    ordered = rows.withColumn("place", F.struct("key", "size", "text_crc32", "row"))
    numbered = occurrence_no(ordered, ["shard"], "place")
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                           F.col("occurrence_no").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", files: int = 1) -> DataFrame:
    """Writes ``docs`` into the folders ``path/shard=0`` and so on, each as ``files`` files or fewer, and reads them back.

    Rows are dealt to (shard, file) by the key and a hash of the whole row, so a key that most rows repeat fills all files of its shard.
    """
    rows = docs.select(others(docs, ["shard"]).alias("d"), stable_key(F.col(f"`{key}`")).alias("k"))
    dealt = rows.select("d", shard_of(F.col("k"), shards).alias("shard"), F.pmod(F.xxhash64("d"), F.lit(files)).cast("int").alias("file"))
    dealt.repartitionById(shards * files, F.col("shard") * files + F.col("file")).select("d.*", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
