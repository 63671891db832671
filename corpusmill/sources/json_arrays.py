"""Large JSON arrays read by many tasks.

A file is read as text between commas, which Spark can split anywhere. A comma alone doesn't say whether it parts two
elements or stands in a string or deeper down, so two passes are made. The first tells for every split how it changes
what holds behind it: whether a string is open, and the depth of brackets for either case. Added up over the splits of a
file, that is the state in which each split begins. The second pass then cuts every split at the commas of the top
level; elements that reach over splits are put together from their fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.session import materialize

QUOTE, BACKSLASH, COMMA, OPEN_ARRAY, CLOSE_ARRAY, OPEN_OBJECT, CLOSE_OBJECT = b'"\\,[]{}'
LEAD, WHOLE, TAIL = 0, 1, 2


def strings_and_steps(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """For each byte whether it stands outside of strings and what it adds to the depth there, and whether a string is open
    behind the last one. An escape never reaches over the start of ``data``, which follows a comma or begins the file."""
    quote = data == QUOTE
    back = data == BACKSLASH
    if back.any():
        # A quote behind an odd number of backslashes is escaped.
        at = np.arange(len(data))
        other = np.maximum.accumulate(np.where(back, -1, at))
        run = np.concatenate([[0], (at - other)[:-1]])
        quote &= run % 2 == 0
    before = np.cumsum(quote) - quote
    outside = ((before & 1) == inside) & ~quote
    steps = ((data == OPEN_ARRAY) | (data == OPEN_OBJECT)).astype(np.int8) - ((data == CLOSE_ARRAY) | (data == CLOSE_OBJECT)).astype(np.int8)
    return outside, steps, bool((int(quote.sum()) + inside) & 1)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, dict, np.ndarray]]:
    """(file, start of the split, row of further columns, bytes) of consecutive rows of one split, with their commas."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch["file"], batch["start"].to_numpy()
        # Files and splits follow each other in a task.
        names = files.dictionary_encode()
        code = names.indices.to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1]) | (code[1:] != code[:-1])]))
        for a, b in zip(cuts, [*cuts[1:], len(starts)]):
            key = (files[int(a)].as_py(), int(starts[a]))
            values = batch["value"].slice(a, b - a)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.binary())), b",")[0].as_py()
            # Each row but the file's first follows a comma.
            body = text if last != key and key[1] == 0 else b"," + text
            last = key
            more = {c: batch[c][int(a)].as_py() for c in batch.schema.names if c not in ("file", "start", "value")}
            yield *key, more, np.frombuffer(body, np.uint8)


def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: whether it has an odd number of quotes, what it adds to the depth if it begins outside or inside of a
    string, and its first byte that isn't blank."""
    held = None
    for file, start, _, data in stretches(batches):
        if held is None or held["file"] != file or held["start"] != start:
            if held:
                yield pa.RecordBatch.from_pylist([held])
            held = {"file": file, "start": start, "odd": 0, "outside": 0, "inside": 0, "first": None}
        outside, steps, open_ = strings_and_steps(data, bool(held["odd"]))
        quoted = ~outside & (data != QUOTE)
        held["outside"] += int(steps[outside].sum())
        held["inside"] += int(steps[quoted].sum())
        held["odd"] = int(open_)
        if held["first"] is None:
            solid = data[~np.isin(data, np.frombuffer(b" \t\r\n", np.uint8))]
            held["first"] = int(solid[0]) if len(solid) else None
    if held:
        yield pa.RecordBatch.from_pylist([held])


def elements(batches: Iterator[pa.RecordBatch], kinds: set[int]) -> Iterator[pa.RecordBatch]:
    """(file, start, kind, text, cut): what stands before a split's first cut, between its cuts, and behind the last one. Cuts are the commas
    of the array and its two brackets. A file that is no array is one element. Only rows of ``kinds`` come."""
    key, buffer, cut, inside, depth = None, [], False, False, 0

    def rest() -> list:
        return [(*key, TAIL if cut else LEAD, b"".join(buffer), cut)]

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FRAGMENT.types)], schema=FRAGMENT)

    for file, start, state, data in stretches(batches):
        rows = []
        if key != (file, start):
            if key is not None:
                rows += rest()
            key, buffer = (file, start), []
            inside, depth, cut = bool(state["inside_"]), state["depth"], start == 0 and state["top"] != OPEN_ARRAY
        outside, steps, inside = strings_and_steps(data, inside)
        steps = np.where(outside, steps, 0)
        level = depth + np.cumsum(steps)
        depth = int(level[-1]) if len(level) else depth
        where = np.zeros(0, np.int64)
        if state["top"] == OPEN_ARRAY:
            where = np.flatnonzero(outside & (((data == COMMA) & (level == 1)) | ((steps > 0) & (level == 1)) | ((steps < 0) & (level == 0))))
        raw, at = data.tobytes(), 0
        for c in where.tolist():
            text = b"".join([*buffer, raw[at:c]])
            rows.append((*key, WHOLE if cut else LEAD, text, cut))
            buffer, at, cut = [], c + 1, True
        buffer.append(raw[at:])
        rows = [r for r in rows if r[2] in kinds]
        if rows:
            yield table(rows)
    if key is not None and (rows := [r for r in rest() if r[2] in kinds]):
        yield table(rows)


FRAGMENT = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("text", pa.binary()), ("cut", pa.bool_())])
FRAGMENT_DDL = "file string, start bigint, kind int, text binary, cut boolean"


def element_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): every element of the arrays in the files of ``path``, as text; in no order."""
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    told = materialize(pieces.mapInArrow(changes, "file string, start bigint, odd bigint, outside bigint, inside bigint, first bigint"), "json-splits")
    splits = W.partitionBy("file").orderBy("start")
    before = splits.rowsBetween(W.unboundedPreceding, -1)
    open_ = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    told = told.withColumn("inside_", open_).withColumn("step", F.when(F.col("inside_") == 1, F.col("inside")).otherwise(F.col("outside")))
    first = F.first("first", ignorenulls=True).over(splits.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    states = told.select("file", "start", "inside_", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"), first.alias("top"))
    begun = pieces.join(F.broadcast(materialize(states, "json-states")), ["file", "start"])  # one short row a split

    whole = begun.mapInArrow(lambda b: elements(b, {WHOLE}), FRAGMENT_DDL).select("file", "text")
    ends = materialize(begun.mapInArrow(lambda b: elements(b, {LEAD, TAIL}), FRAGMENT_DDL), "json-ends")
    # What leads a split goes on with the last element that an earlier split has begun.
    cuts = ends.groupBy("file", "start").agg(F.max((F.col("kind") == TAIL).cast("int")).alias("began"))
    chains = cuts.select("file", "start", F.last(F.when(F.col("began") == 1, F.col("start")), ignorenulls=True).over(before).alias("chain"))
    linked = ends.join(chains, ["file", "start"]).withColumn("chain", F.when(F.col("kind") == TAIL, F.col("start")).otherwise(F.col("chain")))
    listed = linked.where("chain IS NOT NULL").groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("start", F.hex("text").alias("text")))).alias("parts"))
    joined = listed.select("file", F.unhex(F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("text"))
    texts = whole.unionByName(joined).select("file", F.decode("text", "UTF-8").alias("text"))
    return texts.where(F.trim(F.regexp_replace("text", r"[\r\n\t]+", " ")) != "")


def scan_large_arrays(spark: SparkSession, path: str | list[str], schema) -> DataFrame:
    """The elements of JSON arrays as rows of ``schema``, whatever the size of a file; elements that are no objects are null rows."""
    return element_texts(spark, path).select(F.from_json("text", schema).alias("r")).select("r.*")
