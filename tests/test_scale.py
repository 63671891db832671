"""The distributed forms against brute force, with hot keys and small cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking as K
from corpusmill.operators import dedupe, dense, lexical
from corpusmill.operators import entities, fusion, publish
from corpusmill.operators import relational as R
from corpusmill.session import materialize

rng = np.random.default_rng(7)


@pytest.fixture(scope="module")
def hot(spark):
    """Half of all rows share one key."""
    random.seed(3)
    rows = [(i, "hot" if i % 2 else f"k{random.randint(0, 5)}", f"v{i}") for i in range(400)]
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id bigint, key string, v string").repartition(5)


def by_key(rows):
    groups = {}
    for i, key, v in sorted(rows):
        groups.setdefault(key, []).append((i, v))
    return groups


def test_occurrence_numbers_across_cells(hot):
    rows, df = hot
    got = {r.id: r.occurrence_no for r in dedupe.occurrence_no(df, ["key"], "id").collect()}
    assert got == {i: n for g in by_key(rows).values() for n, (i, _) in enumerate(g)}


def test_hash_like_ids_of_a_hot_key_are_dealt_into_even_cells(hot, spark):
    rows, df = hot
    name, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(name, "false")
    try:
        hashed = df.withColumn("id", F.xxhash64("id"))
        cells = dedupe.key_cells(hashed, ["key"], "id").where("key = 'hot'").groupBy("_cell").count().collect()
        got = {(r.key, r.id): r.occurrence_no for r in dedupe.occurrence_no(hashed, ["key"], "id").collect()}
        ids = sorted(r.id for r in hashed.where("key = 'hot'").collect())
    finally:
        spark.conf.set(name, before)
    assert len(cells) >= 3 and max(c["count"] for c in cells) <= len(rows) / 4
    assert all(got["hot", i] == n for n, i in enumerate(ids)) and len(got) == len(rows)


def test_previous_rows_across_cells(hot):
    rows, df = hot
    got = {r.id: r.previous for r in R.previous_rows(df, "key", "id", F.col("v"), 4, width=6).collect()}
    assert got == {i: [v for _, v in g[max(0, n - 4):n]] for g in by_key(rows).values() for n, (i, _) in enumerate(g)}


def test_first_record_and_duplicates(hot):
    rows, df = hot
    flagged = dedupe.flag_duplicates(df, [F.col("key")], "id").collect()
    assert {r.id for r in flagged if not r.duplicate} == {g[0][0] for g in by_key(rows).values()}
    assert len(flagged) == len(rows)


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 5, "w"), ("c", 0, "n")], "k string, t int, v string")
    got = {r.k: r.v for r in dedupe.upsert_latest(old, new, ["k"], "t").collect()}
    assert got == {"a": "z", "b": "w", "c": "n"}


def test_stream_upsert_over_batches_and_a_repeat(spark, tmp_path):
    from corpusmill.streaming import screen
    path = str(tmp_path / "table")
    rows = lambda xs: spark.createDataFrame(xs, "k string, t int, v string")
    source, schema = tmp_path / "in", "k string, t int, v string"
    for part in ([("a", 1, "x"), ("b", 5, "y"), ("a", 0, "old")], [("a", 2, "z"), ("c", 0, "n"), ("b", 5, "y2")]):
        rows(part).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        screen.upsert_batches(stream, path, str(tmp_path / "progress")).awaitTermination()
    got = screen.read_upserts(spark, path, schema, ["k"], "t")
    assert {r.k: r.v for r in got.collect()} == {"a": "z", "b": "y2", "c": "n"}
    rows([("a", 2, "z"), ("c", 0, "n"), ("b", 5, "y2")]).write.mode("overwrite").parquet(f"{path}/batch=1")  # a batch may run again
    assert {r.k: r.v for r in screen.read_upserts(spark, path, schema, ["k"], "t").collect()} == {"a": "z", "b": "y2", "c": "n"}


@pytest.mark.parametrize("per_batch", [3, 10_000])
def test_sessions_do_not_depend_on_batches(spark, tmp_path, per_batch):
    from corpusmill.streaming import screen, sessions
    held = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.STATE_STORE)
    schema, source = "conv_id bigint, turn bigint, question string, answer string", str(tmp_path / "in")
    try:
        for turns in (range(9, -1, -1), [11, 10, 13, 14], [12]):  # the last one comes late
            spark.createDataFrame([(c, n, f"q{n}", f"a{n}") for n in turns for c in (1, 2)], schema).coalesce(1).write.mode("append").json(source)
            stream = sessions.stream_sessions(spark.readStream.schema(schema).json(source), turns=3)
            screen.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
        got = {(r.conv_id, r.turn): r.transcript for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    said = {n: f"User: q{n}\nAssistant: a{n}" for n in range(15)}
    for c in (1, 2):
        for n in range(12):
            assert got[c, n] == "\n".join(said[i] for i in range(max(0, n - 3), n)), n
        assert got[c, 13] == "\n".join(said[i] for i in (9, 10, 11)) and got[c, 12] == "\n".join(said[i] for i in (11,))


def test_ranked_elements(spark):
    values = [5, 1, 1, 9, 7, 7]
    got = R.ranked_elements(spark.createDataFrame([(v,) for v in values], "v int"), F.col("v"), low=(0, 1), p10=(1, 10), median=(1, 2)).collect()[0]
    s = sorted(values)
    assert (got.low, got.p10, got.median) == (s[0], s[len(s) // 10], s[len(s) // 2])


def vectors(n, copies=0):
    v = rng.normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[n - copies:] = v[0]  # equal vectors tie and fall back to the id
    return v.astype(np.float32)


def test_both_dense_routes_equal_brute_force(spark):
    v, q = vectors(300, 100), vectors(20)
    q[0] = v[0]
    keys = [None if i % 5 == 0 else f"k{i % 3}" for i in range(300)]
    scopes = [[] if i % 3 == 0 else [f"k{i % 2}"] for i in range(20)]
    vdf = spark.createDataFrame([(i, v[i].tolist(), keys[i]) for i in range(300)], "id bigint, vec array<float>, key string").repartition(4)
    qdf = spark.createDataFrame([(i, q[i].tolist(), scopes[i]) for i in range(20)], "qid bigint, qvec array<float>, scope array<string>")
    scores = np.round(q.astype(np.float64) @ v.astype(np.float64).T, 9)
    want = {}
    for i in range(20):
        seen = [j for j in range(300) if not scopes[i] or keys[j] is None or keys[j] in scopes[i]]
        want[i] = sorted(seen, key=lambda j: (-scores[i, j], j))[:5]
    block = dense.BLOCK_BYTES
    dense.BLOCK_BYTES = 64 * 16 * 8
    try:
        for limit in (1 << 20, 8 * 16 * 3):  # the second holds three queries only, so there are seven blocks of queries
            scoped = {}
            for r in dense.dense_topk(qdf.where("size(scope) > 0"), vdf, 5, limit).orderBy("qid", "rank").collect():
                scoped.setdefault(r.qid, []).append(r.id)
            assert scoped == {i: ids for i, ids in want.items() if scopes[i]}
            got = {}
            for r in dense.dense_topk(qdf, vdf, 5, limit).orderBy("qid", "rank").collect():
                got.setdefault(r.qid, []).append(r.id)
            assert got == want
    finally:
        dense.BLOCK_BYTES = block


def test_mmr_equals_brute_force(spark):
    v = vectors(80)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(80)], "id bigint, vec array<float>")
    got = {}
    for r in dense.mmr(df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), df, 4, fetch=10).orderBy("qid", "pick").collect():
        got.setdefault(r.qid, []).append(r.id)
    sims = np.round(v.astype(np.float64) @ v.astype(np.float64).T, 9)
    for q in range(80):
        left = sorted(range(80), key=lambda j: (-sims[q, j], j))[:10]
        chosen = [left.pop(0)]
        while len(chosen) < 4:
            best = max(left, key=lambda j: (0.5 * sims[q, j] - 0.5 * max(sims[j, c] for c in chosen), -left.index(j)))
            left.remove(best)
            chosen.append(best)
        assert got[q] == chosen


def test_bm25_without_broadcast_is_the_same(spark):
    docs = spark.createDataFrame([(i, ["hot"] * (i % 4 + 1) + [f"t{i % 7}", f"u{i % 3}"]) for i in range(120)], "id bigint, terms array<string>")
    q = spark.createDataFrame([(0, ["hot", "t1", "t1"]), (1, ["u2", "none"])], "qid bigint, terms array<string>")
    small = sorted(map(tuple, lexical.bm25_topk(q, docs, 10).collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(map(tuple, lexical.bm25_topk(q, docs, 10).collect())) == small and len(small) == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_protection_replaces_the_lowest(spark):
    ranks = lambda ids: spark.createDataFrame([(0, i, r + 1) for r, i in enumerate(ids)], "qid bigint, id bigint, rank int")
    fused = fusion.rrf_fuse({"dense": ranks(range(1, 21)), "bm25": ranks([99, *range(2, 10)])})
    kept = {r.id for r in fusion.protect_top1(fused, 3).collect()}
    assert {1, 99} <= kept and len(kept) == 3


def test_aliases_match_whole_words_only(spark):
    aliases = spark.createDataFrame([("liq", "liquid"), ("fc", "flexi-cap"), ("fc", "flexi cap"),
                                     ("six", "one two three four five six")], "entity_id string, alias string")
    m = spark.createDataFrame([(1, "the Liquid one"), (2, "liquidity is fine"), (3, "FLEXI-CAP?"), (4, "flexi. cap"), (5, "a one two three four five six b")], "id bigint, t string")
    assert {(r.id, r.entity_id) for r in entities.alias_match_join(m, aliases, "id", "t").collect()} == {(1, "liq"), (3, "fc"), (5, "six")}
    found = entities.resolve_entities(F.lit("Acme liquid fund load"), {"liq": ["liquid", "liquid fund"]}, ["acme"], ["plan"])
    out = spark.range(1).select(found.alias("e")).collect()[0].e
    assert out.ids == ["liq"] and out.stripped == "load"


def test_multisets_without_lists(spark):
    got = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b")], "k int, l string")
    want = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "a")], "k int, l string")
    assert {(r.k, r.same_multiset, r.same_set) for r in R.multiset_match(got, want, "k", "l").collect()} == {(1, False, True), (2, True, True)}


def test_chunks_keep_every_token_and_stay_small(spark):
    text = " ".join(f"w{i}" for i in range(1000)) + "\n\n" + "\n".join(f"- item {i} of the list" for i in range(120)) + "\nTerm | Meaning\n---|---\n" + "\n".join(
        f"T{i} | meaning {i}" for i in range(40))
    dotted = ".".join(f"w{i}" for i in range(1000))  # no break but between tokens
    pieces = spark.range(1).select(K.split_body(F.lit(text)).alias("p"), K.prose_split(F.lit(dotted)).alias("w")).collect()[0]
    sizes = [len(__import__("re").findall(r"\w+", p)) for p in pieces.p]
    assert max(sizes) <= K.P.CHUNK_MAX_TOKENS + K.P.CHUNK_SLACK_TOKENS
    joined = " ".join(pieces.p)
    assert all(f"w{i}" in joined for i in range(1000)) and all(f"item {i} " in joined for i in range(120))
    assert sum(p.startswith("T") and ": meaning" in p for p in pieces.p) == 40  # one piece per term, never merged
    whole = __import__("re").findall(r"\w+", dotted)
    back = []
    for w in pieces.w:
        tokens = __import__("re").findall(r"\w+", w)
        back += tokens if not back else tokens[K.P.CHUNK_OVERLAP_TOKENS:]
    assert back == whole


def split_plainly(text, size, lap, breaks, last, measure):
    """The recursive rule, one text at a time: cut at the coarsest break, join what is small with overlap."""
    import re

    def join(parts):
        done, held = [], []
        for part in parts:
            if held and sum(map(measure, held)) + measure(part) > size:
                done.append("".join(held))
                while sum(map(measure, held)) > lap or 0 < sum(map(measure, held)) > size - measure(part):
                    held = held[1:]
            held = [*held, part]
        return [t for t in (x.strip() for x in [*done, "".join(held)]) if t]

    first, *finer = breaks or [None]
    parts = re.findall(last, text, re.S) if first is None else [first * (i > 0) + x for i, x in enumerate(text.split(first))]
    out, small = [], []
    for part in filter(None, parts):
        if measure(part) < size or first is None:
            small.append(part)
        else:
            out += join(small) + split_plainly(part, size, lap, finer, last, measure)
            small = []
    return out + join(small)


def test_recursive_split_follows_the_plain_rule(spark):
    import random
    import re
    rnd = random.Random(5)
    marks = ["w", "word ", "x. ", "end.\n", "p\n\n", "\n", "\n\n\n", "--- ", ".", "é "]
    texts = ["", "a", "\n\n", "a.b.c.d.e.f.g.h.i.j.k.l.m.n"] + ["".join(rnd.choices(marks, k=rnd.randint(1, 200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = df.select("t", K.prose_split(F.col("t"), 12, 4).alias("tokens"),
                    K.recursive_split(F.col("t"), F.lit(15), F.lit(5), K.PLAIN_BREAKS, r"(?s).", F.length).alias("chars")).collect()
    for r in got:
        assert r.tokens == split_plainly(r.t, 12, 4, K.PROSE_BREAKS, r"\A\W*\w+\W*|\w+\W*", lambda x: len(re.findall(r"\w+", x))), r.t
        assert r.chars == split_plainly(r.t, 15, 5, K.PLAIN_BREAKS, ".", len), r.t


def test_nothing_is_written_when_a_check_fails(spark, tmp_path):
    wrote = []
    bad = spark.createDataFrame([(f"id{i}", "missing nav") for i in range(30)], "id string, problem string")
    with pytest.raises(publish.Rejected, match="30 problems") as caught:
        publish.publish_if_valid(bad, lambda: wrote.append(1))
    assert spark.read.parquet(caught.value.report).where("problem = 'missing nav'").count() == 30
    publish.publish_if_valid(bad.limit(0), lambda: wrote.append(2))
    assert wrote == [2]


def test_fingerprint_ignores_order_and_sees_changes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id int, t string")
    first = publish.content_fingerprint(df, ["id", "t"])
    assert first.collect() == publish.content_fingerprint(df.orderBy(F.desc("id")).repartition(7), ["id", "t"]).collect()
    assert first.collect() != publish.content_fingerprint(df.withColumn("t", F.upper("t")), ["id", "t"]).collect()
    path = str(tmp_path / "info")
    assert not publish.is_up_to_date(spark, path, first, "m")
    publish.store_fingerprint(path, first, "m")
    assert publish.is_up_to_date(spark, path, first, "m") and not publish.is_up_to_date(spark, path, first, "n")
    with pytest.raises(publish.Rejected):
        publish.require_model(spark, path, "n")


def test_replacing_children_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "x")], "k int, v string")
    once = publish.replace_children(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, publish.replace_children(once, new, "k").collect())) == [(1, "x"), (2, "c")]


def test_materialize_cuts_the_lineage(spark):
    df = materialize(spark.range(100).withColumn("x", F.col("id") * 2), "probe")
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 100


def test_tasks_need_no_installed_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    payload = tmp_path / "best.pkl"
    payload.write_bytes(cloudpickle.dumps((dense.Best, dense.matrix)))
    code = f"import pickle; print(pickle.load(open({str(payload)!r}, 'rb'))[0].__name__)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"}).stdout.strip() == "Best"
