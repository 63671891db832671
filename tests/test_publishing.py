"""Snapshots that change together, and keyed tables that change in batches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import facts, publish
from corpusmill.operators.keyed import KeyedTable
from corpusmill.operators.snapshots import Checked, Snapshots
from corpusmill.sources import store

NAMES = ["schemes", "managers", "holdings", "returns", "ratios", "analysis"]


def six(spark, n):
    return {name: spark.range(n + i).withColumn("v", F.lit(n)) for i, name in enumerate(NAMES)}


def held(collection):
    return {name: (collection.read(name).count(), collection.read(name).agg(F.max("v")).head()[0]) for name in NAMES}


def test_a_write_that_dies_between_two_tables_leaves_the_old_six(spark, tmp_path):
    collection = Snapshots(spark, str(tmp_path / "c"))
    assert collection.current() is None and collection.counts().count() == 0
    with pytest.raises(LookupError):
        collection.read("schemes")
    collection.publish(six(spark, 10))
    before = held(collection)
    broken = six(spark, 20)
    broken["returns"] = broken["returns"].withColumn("v", F.raise_error(F.lit("gone")).cast("int"))
    with pytest.raises(Exception, match="gone"):
        collection.publish(broken)
    assert held(collection) == before == {name: (10 + i, 10) for i, name in enumerate(NAMES)}
    collection.publish(six(spark, 20))
    assert held(collection) == {name: (20 + i, 20) for i, name in enumerate(NAMES)}
    assert {r.table_name: r.n_rows for r in collection.counts().collect()} == {name: 20 + i for i, name in enumerate(NAMES)}


def test_old_versions_go_when_told(spark, tmp_path):
    collection = Snapshots(spark, str(tmp_path / "c"))
    versions = [collection.publish(six(spark, n))["version"] for n in (1, 2, 3)]
    assert collection.read("schemes", versions[0]).count() == 1  # a reader that holds an old version
    assert collection.clean() == [versions[0]] and collection.clean() == []
    assert collection.read("schemes", versions[1]).count() == 2 and collection.read("schemes").count() == 3


def test_a_rejected_run_leaves_the_pointer_and_lists_every_problem(spark, tmp_path):
    collection = Snapshots(spark, str(tmp_path / "c"))
    collection.publish(six(spark, 5))
    pointer = store.read_text(spark, collection.pointer)
    rows = spark.createDataFrame([("a", None, []), ("b", "", ["x"]), ("c", "ok", ["x"])], "id string, name string, items array<string>")
    checked = Checked(rows, "id", facts.missing(["name"], {"items": "no items"}))
    with pytest.raises(publish.Rejected, match="3 problems") as caught:
        collection.publish({"schemes": spark.range(1), "records": checked})
    listed = {tuple(r) for r in spark.read.parquet(caught.value.report).collect()}
    assert listed == {("records", "a", "missing name"), ("records", "a", "no items"), ("records", "b", "missing name")}
    assert store.read_text(spark, collection.pointer) == pointer and len(store.folders(spark, f"{collection.root}/versions")) == 1
    collection.publish({"records": Checked(rows.where("id = 'c'"), "id", facts.missing(["name"]))})
    assert collection.counts().collect() == [("records", 1)]


def test_a_valid_publication_reads_its_rows_once(spark, tmp_path):
    """Rows, problems and the table itself come from one job of one stage for each table."""
    collection, tracker = Snapshots(spark, str(tmp_path / "c")), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("publish", "publish")
    collection.publish({"a": Checked(spark.range(100, numPartitions=4), "id", F.when(F.col("id") < 0, F.array(F.lit("negative"))))})
    jobs = tracker.getJobIdsForGroup("publish")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1 and collection.counts().head().n_rows == 100


def test_rebuild_reports_what_it_wrote(spark, tmp_path):
    got = publish.rebuild_tables(spark, six(spark, 3), path=str(tmp_path / "t"))
    assert {r.table_name: r.n_rows for r in got.collect()} == {name: 3 + i for i, name in enumerate(NAMES)}


# ---- keyed tables

SCHEMA = "k string, t int, v string"


def latest_of(batches):
    """Newest record of each key over (batch, [(key, order, value or None for a deletion)])."""
    best = {}
    for n, rows in batches.items():
        for k, t, v in rows:
            new = (t, n, v is None, v or "")
            if k not in best or new > best[k]:
                best[k] = new
    return {(k, t, v) for k, (t, n, gone, v) in best.items() if not gone}


def put(spark, table, n, rows):
    df = spark.createDataFrame([(k, t, v, v is None) for k, t, v in rows], SCHEMA + ", gone boolean")
    return table.write(df, n, F.col("gone"))


@pytest.mark.parametrize("seed", range(3))
def test_any_interleaving_of_batches_repeats_and_compactions(spark, tmp_path, seed):
    rng = random.Random(seed)
    keys = [None, *"abcdefgh"]
    batches = {n: [(rng.choice(keys), rng.randrange(5), rng.choice([None, "x", "y", "z"])) for _ in range(rng.randrange(0, 12))] for n in range(7)}
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "t", buckets=4)
    written = {}
    for n in range(7):
        put(spark, table, n, batches[n])
        written[n] = batches[n]
        for _ in range(rng.randrange(3)):
            if rng.random() < 0.5:
                again = rng.randrange(n + 1)
                assert put(spark, table, again, batches[again]) == (again > table.upto())
            else:
                table.compact()
        if rng.random() < 0.4:
            table.clean()
        fresh = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "t")  # a reader knows the folder only
        assert {tuple(r) for r in fresh.read().collect()} == latest_of(written)


def test_an_older_record_does_not_bring_a_deleted_key_back(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "t", buckets=2)
    put(spark, table, 0, [("a", 3, "x"), ("b", 1, "y")])
    table.remove(spark.createDataFrame([("a",)], "k string"), 1, F.lit(5))
    table.compact()
    table.clean()
    put(spark, table, 2, [("a", 4, "late")])
    assert [tuple(r) for r in table.read().collect()] == [("b", 1, "y")]
    put(spark, table, 3, [("a", 6, "back")])
    assert {tuple(r) for r in table.read().collect()} == {("b", 1, "y"), ("a", 6, "back")}
    with pytest.raises(ValueError):
        table.remove(spark.createDataFrame([("a",)], "k string"), 4)


def test_readers_take_the_base_and_newer_deltas_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "t", buckets=4)
    rows = [(f"k{i}", 0, "v") for i in range(40)]
    for n in range(12):
        put(spark, table, n, [(k, n, v) for k, _, v in rows])
    before = len(table.read().inputFiles())
    assert table.compact() == 12 and table.compact() == 0
    after = len(table.load(table.paths()).inputFiles())
    assert before >= 12 * 4 and after <= 4
    # One key touches one bucket; the other three keep the folders they have.
    base = table.state()["base"]
    put(spark, table, 12, [("k1", 99, "new")])
    table.compact()
    changed = [k for k, v in table.state()["base"].items() if base[k] != v]
    assert len(changed) == 1 and table.read().count() == 40 and table.read().where("t = 99").count() == 1
    table.clean()
    assert table.read().count() == 40 and store.folders(spark, f"{table.root}/deltas") == []


def test_an_unfinished_delta_is_not_read(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "t")
    put(spark, table, 0, [("a", 1, "x")])
    put(spark, table, 1, [("a", 2, "y")])
    assert store.delete(spark, f"{table.root}/deltas/batch=1/_SUCCESS")  # as if its writer died
    assert [tuple(r) for r in table.read().collect()] == [("a", 1, "x")] and table.compact() == 1
    put(spark, table, 1, [("a", 2, "y")])
    assert [tuple(r) for r in table.read().collect()] == [("a", 2, "y")]


def test_children_are_replaced_as_a_whole(spark, tmp_path):
    steps = {0: [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "n")], 1: [(1, "x")], 2: [(3, "d"), (3, "e"), (None, "m"), (None, "m")]}
    for folds in itertools.product([False, True], repeat=3):
        table = KeyedTable(spark, str(tmp_path / f"t{folds}"), "k int, v string", ["k"], buckets=3)
        for n, rows in steps.items():
            table.write(spark.createDataFrame(rows, "k int, v string"), n)
            if folds[n]:
                table.compact()
        table.remove(spark.createDataFrame([(2,)], "k int"), 3)
        got = sorted(map(tuple, table.read().collect()), key=str)
        assert got == sorted([(1, "x"), (3, "d"), (3, "e"), (None, "m"), (None, "m")], key=str)


def test_upserts_from_a_stream(spark, tmp_path):
    from corpusmill.streaming import screen
    source, table = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "t", buckets=4)
    batches = {n: [(f"k{(n * 3 + i) % 7}", (n * 5 + i) % 6, f"{n}-{i}") for i in range(6)] for n in range(6)}
    for n, rows in batches.items():
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(SCHEMA).json(source)
        screen.upsert_stream(stream, table, str(tmp_path / "progress"), compact_every=2).awaitTermination()
        assert {tuple(r) for r in table.read().collect()} == latest_of({m: batches[m] for m in range(n + 1)})
    assert table.upto() == 5 and table.finished() == []


# ---- buckets that are built anew

def test_only_changed_buckets_are_built(spark, tmp_path):
    from corpusmill.operators.buckets import BUCKET, BucketBuild
    index, seen = BucketBuild(spark, str(tmp_path / "i"), ["id"], buckets=8), []

    def build(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        return rows.where("text <> 'nothing'").select("id", F.upper("text").alias("text"), BUCKET)

    def held(rows):
        return {(i, t.upper()) for i, t in rows if t != "nothing"} == {tuple(r) for r in index.read().collect()}

    with pytest.raises(LookupError):
        index.read()
    rows = [(i, f"t{i}") for i in range(40)] + [(100, "nothing")]
    df = lambda: spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    assert len(index.refresh(df(), ["id", "text"], "m", build)) == 8 and held(rows)
    assert index.refresh(df(), ["id", "text"], "m", build) == [] and len(seen) == 1
    rows[3] = (3, "changed")
    assert len(index.refresh(df(), ["id", "text"], "m", build)) == 1 and 3 in seen[-1] and len(seen[-1]) < 15 and held(rows)
    rows.pop(7)
    rows.append((500, "new"))
    assert 1 <= len(index.refresh(df(), ["id", "text"], "m", build)) <= 2 and held(rows)
    assert len(index.refresh(df(), ["id", "text"], "other", build)) == 8 and held(rows)
    with pytest.raises(publish.Rejected):
        index.read("m")
    assert index.clean() > 0 and held(rows) and index.clean() == 0
    rows = [r for r in rows if r[0] == 3]  # most buckets are empty now
    assert index.refresh(df(), ["id", "text"], "other", build) != [] and held(rows)
    rows = []
    index.refresh(df(), ["id", "text"], "other", build)
    assert index.read().count() == 0


def test_a_build_that_fails_leaves_the_last_result(spark, tmp_path):
    from corpusmill.operators.buckets import BUCKET, BucketBuild
    index = BucketBuild(spark, str(tmp_path / "i"), ["id"], buckets=4)
    df = spark.range(20).withColumn("v", F.lit(1))
    index.refresh(df, ["id", "v"], "m", lambda rows: rows)
    with pytest.raises(Exception, match="gone"):
        index.refresh(df.withColumn("v", F.lit(2)), ["id", "v"], "m", lambda rows: rows.withColumn("v", F.raise_error(F.lit("gone")).cast("int")))
    with pytest.raises(ValueError):
        index.refresh(df.withColumn("v", F.lit(2)), ["id", "v"], "m", lambda rows: rows.drop(BUCKET))
    assert index.read("m").agg(F.sum("v")).head()[0] == 20
