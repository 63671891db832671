"""Sharding: the jump sequence number by number, least movement, gapless slots, hot keys, odd input."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import jump_shards


def one_jump(key, shards):
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def key_of(doc_id):
    return int(hashlib.sha256(("-" if doc_id is None else f"+{doc_id}").encode()).hexdigest()[:15], 16)


def test_jumps():
    rng = np.random.default_rng(13)
    keys = np.concatenate([rng.integers(-2**63, 2**63 - 1, 3000), [0, 1, -1, 2**63 - 1, -2**63]])
    for shards in (1, 2, 3, 16, 17, 1000):
        got = jump_shards.jump(keys, shards)
        assert got.tolist() == [one_jump(int(k) % 2**64, shards) for k in keys]
    assert jump_shards.jump(np.zeros(0, np.int64), 4).tolist() == []
    with pytest.raises(ValueError):
        jump_shards.jump(keys, 0)


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.arange(200_000) * 7919
    before = jump_shards.jump(keys, 16)
    share = np.bincount(before) / len(keys)
    assert abs(share - 1 / 16).max() < 0.004
    for more in (17, 20):
        after = jump_shards.jump(keys, more)
        changed = before != after
        assert (after[changed] >= 16).all() and abs(changed.mean() - (more - 16) / more) < 0.01


ROWS = [(1, "a"), (1, "a"), (1, "é"), (None, None), (None, None), (None, "x"), (2, ""), (3, None), (4, "long " * 100_000), (-5, "a")]


def checked(rows, got, shards):
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard, r.grown_shard, r.law) == (one_jump(key_of(r.doc_id), shards), one_jump(key_of(r.doc_id), shards + 1), "key")
    body = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == body
    for shard in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in own]
        assert order == sorted(order)


def test_manifest(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    for name in ("shard", "slot", "row", "key", "place", "size", "d", "k"):
        df = df.withColumn(name, F.lit("mine"))
    for shards in (1, 16):
        checked(ROWS, jump_shards.manifest(df, shards).collect(), shards)
    assert jump_shards.manifest(df.limit(0)).count() == 0
    assigned = jump_shards.assign(df)
    assert assigned.count() == len(ROWS) and {r.k for r in assigned.collect()} == {"mine"}


def test_a_key_of_most_rows_is_numbered_by_many_tasks(spark):
    df = spark.range(0, 6000, 1, 6).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    # So small a table would be read by one task otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = jump_shards.manifest(df)
        checked([(7 if i % 3 else i, "same") for i in range(6000)], got.collect(), 16)
        hot = got.where("doc_id = 7").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(hot) > 1 and max(r["count"] for r in hot) < 3000


def test_files_and_moves(spark, tmp_path):
    df = spark.createDataFrame([*ROWS, *[(100 + i, f"t{i}") for i in range(300)], *[(7, f"hot {i}") for i in range(300)]], "doc_id bigint, text string")
    back = jump_shards.write_shards(df, str(tmp_path / "sharded"), 16, files=3)
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == Counter((r.doc_id, r.text, one_jump(key_of(r.doc_id), 16)) for r in df.collect())
    files = back.where("doc_id = 7").select(F.input_file_name().alias("f")).distinct().count()
    assert files == 3
    moved = jump_shards.moves(df, 16, 18)
    assert {(r.doc_id, r.old_shard, r.new_shard) for r in moved.collect()} == {
        (r.doc_id, a, b) for r in df.collect() if (a := one_jump(key_of(r.doc_id), 16)) != (b := one_jump(key_of(r.doc_id), 18))}
    assert all(r.new_shard >= 16 for r in moved.collect())
