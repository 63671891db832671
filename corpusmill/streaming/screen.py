"""Screening of arriving messages, before anything is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusmill.functions.screening import pii_placeholder, pii_types, refusal_kind
from corpusmill.operators.dedupe import latest
from corpusmill.operators.keyed import KeyedTable


def stream_screen(messages: DataFrame, text: Column, keep: list[str], house_names: list[str] | None = None) -> DataFrame:
    """Kinds of personal data, refusal and the text that may be kept; stateless, so batch and stream agree row by row."""
    return messages.select(
        *keep, F.array_join(pii_types(text), ", ").alias("kinds"), refusal_kind(text, house_names).alias("refusal"),
        pii_placeholder(text).alias("shown"))


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parquet sink through foreachBatch; a batch that is run again replaces its own folder."""
    def save(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, deleted: Column | None = None, compact_every: int = 16) -> StreamingQuery:
    """Adds every micro-batch to a keyed table as a delta, and folds the deltas into its base whenever ``compact_every`` have
    gathered. A batch that runs again replaces its delta, or is left alone where it is folded already."""
    def save(df: DataFrame, batch_id: int) -> None:
        table.write(df, batch_id, deleted)
        if len(table.finished()) >= compact_every:
            table.compact()

    return (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def upsert_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch of records to a plain log; a batch that runs again replaces itself. What is current is decided when
    reading, over all batches: for logs that end. ``upsert_stream`` keeps what readers take small."""
    return write_batches(stream, path, checkpoint)


def read_upserts(spark: SparkSession, path: str, schema: str | StructType, keys: list[str], order: str) -> DataFrame:
    """Latest record of every key over all batches, as one grouped maximum; on equal order the later batch wins."""
    rows = spark.read.schema(spark.createDataFrame([], schema).schema.add("batch", "long")).parquet(path)
    return latest(rows, keys, [order, "batch"]).drop("batch")
