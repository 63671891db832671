"""Document fingerprints by winnowing: of every window of k-gram hashes the smallest is kept, the rightmost of equal ones.

Any two texts of at least ``k + window - 1`` code points that share a run of as many share a kept hash; positions are kept so
that a match can be located. Short texts have smaller windows, and very short ones shorter grams, or there would be nothing
to compare them by: ``sizes`` states the rule. The work is numpy over whole texts inside tasks; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize

#: Length of a gram in code points, and grams in a window: shared runs of 80 code points are always seen.
K, WINDOW = 20, 61
#: Grams of a text per window, at least: a text of few grams keeps several of them.
WINDOWS = 8
BASE = 0x9E3779B97F4A7C15
LEAST = -(2**63)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hash of every k-gram, by doubling: the hash of 2m code points is made of those of its two halves."""
    have, start, done = codes.astype(np.uint64) + np.uint64(1), None, 0
    power, width = BASE, 1
    left = k
    n = len(codes) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    while left:
        if left & 1:
            # Append a piece of ``width`` code points that starts where the pieces so far end.
            out = out * np.uint64(power) + have[done:done + n]
            done += width
        left >>= 1
        if left:
            have = have[:-width] * np.uint64(power) + have[width:]
            power = power * power % 2**64
            width *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out >> np.uint64(32)


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """Smallest key of each window, by doubling the width."""
    width, have = 1, keys
    while width * 2 <= window:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    rest = window - width
    return np.minimum(have[:len(have) - rest], have[rest:]) if rest else have


def sizes(n: int, k: int = K, window: int = WINDOW) -> tuple[int, int]:
    """Length of a gram and grams in a window for a text of ``n`` code points.

    Grams are halved while the text is shorter than the run that ``k`` and ``window`` guarantee (80 code points; 40 and 20 after
    one and two halves), and no longer than the text. A window holds at most an eighth of the text's grams. Of two texts
    with equal grams the one with the smaller window keeps whatever the other keeps in a shared run, so the guarantee
    holds for all pairs of texts that are as long as the run.
    """
    run = k + window - 1
    while n < run and k > 4:
        k, run = k // 2, run // 2
    k = min(k, n)
    return k, max(1, min(window, (n - k + 1) // WINDOWS))


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions in code points, with the grams and windows of ``sizes``; an empty text has none."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    k, window = sizes(len(codes), k, window)
    hashes = gram_hashes(codes, k)
    # Hash above, place below: the smallest hash wins and among equal ones the largest place.
    places = np.arange(len(hashes), dtype=np.uint64)
    keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - places)
    best = window_minima(keys, window)
    kept = best[np.flatnonzero(np.diff(best, prepend=~best[:1]))]
    return (kept >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two fingerprints' hashes, whatever their positions; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(mark: tuple[np.ndarray, np.ndarray]) -> str:
    """Eight hexadecimal digits of hash and eight of position for each kept gram."""
    return np.stack(mark, axis=1).astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with hashes array<bigint> and positions array<bigint>, ascending by position. Rows stay where they are.

    Null and empty texts get empty arrays, repeated rows equal ones, an empty table stays empty; input columns named
    hashes or positions are replaced.
    """
    from corpusmill.llm.common import append

    @F.pandas_udf("hashes array<bigint>, positions array<bigint>")
    def marks(texts: pd.Series) -> pd.DataFrame:
        found = [winnow(t, k, window) for t in texts]
        return pd.DataFrame({"hashes": [h.astype(np.int64) for h, _ in found], "positions": [p.astype(np.int64) for _, p in found]})

    return append(docs, marks(F.col(text)), ["hashes", "positions"])


def ranges(docs: DataFrame, parts: int) -> list[tuple[int, int]]:
    """The first (id, hash of the text) of each of about ``parts`` even ranges. Reads those two only; at most ``parts`` pairs come
    to the driver. Rows that share an id are parted by their texts, so an id that many rows repeat fills many ranges."""
    keys = materialize(docs.select(key_of("doc_id").alias("key"), F.xxhash64(text_of("text")).alias("turn")).repartitionByRange(parts, "key", "turn").select(
        "key", "turn", F.spark_partition_id().alias("p")), "winnow-keys")
    firsts = keys.groupBy("p").agg(F.min(F.struct("key", "turn")).alias("first")).select("first.*").collect()
    return sorted({(r.key, r.turn) for r in firsts})


def key_of(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id), F.lit(LEAST))


def text_of(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def part_of(firsts: list[tuple[int, int]]):
    """Number of the range that (id, hash) falls in."""
    keys, turns = (np.array(x, dtype=np.int64) for x in zip(*firsts)) if firsts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    @F.pandas_udf("int")
    def part(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        ids, hashes = ids.to_numpy(np.int64), hashes.to_numpy(np.int64)
        low, high = np.searchsorted(keys, ids, side="left"), np.searchsorted(keys, ids, side="right")
        out = high - 1
        # Where ranges begin within the rows of one id, the hash tells which.
        for i in np.flatnonzero(high > low):
            out[i] = low[i] - 1 + np.searchsorted(turns[low[i]:high[i]], hashes[i], side="right")
        return pd.Series(np.maximum(out, 0).astype(np.int32))
    return part


SUCCESSORS = ("doc_id bigint, n_chars bigint, edited string, hashes array<bigint>, positions array<bigint>, "
              "edited_hashes array<bigint>, edited_positions array<bigint>, near_edited double, near_next double")


def next_texts(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (part, ahead, doc_id, text) in which each part is in order and ends with the row that follows it.

    Texts are dealt once, each range to the task of its number. The first row of a part is dealt a second time, to the part
    before it (of the first part: to the last one), so no task needs another's rows. A null doc_id comes first; equal ids
    are ordered by a hash of the text and then the text.
    """
    spark = docs.sparkSession
    firsts = ranges(docs, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = max(1, len(firsts))
    heads = spark.createDataFrame([(*first, (i - 1) % n) for i, first in enumerate(firsts)], "head_key bigint, head_turn bigint, target int")
    rows = docs.select(key_of("doc_id").alias("key"), "doc_id", text_of("text").alias("text")).withColumn("turn", F.xxhash64("text"))
    rows = rows.withColumn("p", part_of(firsts)("key", "turn"))
    # One row for each part: at most ``parts`` short rows are broadcast.
    rows = rows.join(F.broadcast(heads), F.expr("key = head_key AND turn = head_turn"), "left")
    here = F.struct(F.col("p").alias("part"), F.lit(False).alias("ahead"))
    there = F.struct(F.col("target").alias("part"), F.lit(True).alias("ahead"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("target").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return (rows.select("to.part", "to.ahead", "key", "turn", "doc_id", "text").repartitionById(n, "part")
            .sortWithinPartitions("part", "ahead", "key", "turn", "text"))


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """Each document (doc_id, text) against its edited text and against the next document, ascending doc_id.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document; the last
    document is followed by the first, a single one by itself. Null texts count as empty, a null doc_id comes first, rows that
    repeat an id follow each other by a hash of their texts; further columns don't matter.
    """
    def per_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, doc_id, text, fingerprint) of the row that waits for its successor
        for batch in batches:
            out = []
            for part, ahead, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text")]):
                waits = last is not None and last[0] == part
                if not waits and ahead:
                    last = None  # a further row with the first id: only the first of them follows
                    continue
                mark = winnow(text, k, window)
                if waits:
                    _, last_id, old, old_mark = last
                    half = len(old) // 2
                    edited = old[:len(old) - half] + text[:half]
                    new_mark = winnow(edited, k, window)
                    out.append({"doc_id": last_id, "n_chars": len(old), "edited": edited, "hashes": old_mark[0], "positions": old_mark[1],
                                "edited_hashes": new_mark[0], "edited_positions": new_mark[1],
                                "near_edited": likeness(old_mark[0], new_mark[0]), "near_next": likeness(old_mark[0], mark[0])})
                last = None if ahead else (part, doc_id, text, mark)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return next_texts(docs, parts).mapInArrow(per_part, SUCCESSORS)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), *[
    (c, pa.list_(pa.int64())) for c in ("hashes", "positions", "edited_hashes", "edited_positions")],
    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def marks_text(hashes: str, positions: str):
    """The text form of a fingerprint, from its two arrays."""
    @F.pandas_udf("string")
    def text(h: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([as_text((np.asarray(a, np.int64), np.asarray(b, np.int64))) for a, b in zip(h, p)])
    return text(F.col(hashes), F.col(positions))
