"""Stages of the pipeline on odd tables: nothing clean goes, and columns with the operators' names come back."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusmill.llm import ngram_join

ENGLISH = "the quick brown fox jumps over the lazy dog and runs into the forest before the night falls on the hills {}"
GERMAN = "der schnelle braune Fuchs springt über den faulen Hund und läuft in den Wald bevor die Nacht auf die Hügel fällt {}"
LONG = " ".join(f"word{i % 7000} and" for i in range(30_000))
NAMES = ("score", "rejected", "lang_pred", "size", "taken", "copies", "target", "source_size", "copy", "row", "mark", "group", "key", "ids", "n",
         "spans", "place", "_copy", "_made", "draw", "what", "k")
ROWS = [(1, ENGLISH.format(1), "en", "a"), (1, ENGLISH.format(1), "en", "a"), (2, GERMAN.format(2), "de", "a"), (2, ENGLISH.format(1), "en", "b"), (3, None, "en", "a"),
        (4, "", "de", None), (None, GERMAN.format("ohne"), "de", "b"), (None, GERMAN.format("ohne"), "de", "b"), (None, None, None, None),
        (5, LONG, "en", "c"), (6, "Mail bob@x.org, the fox and the dog went into the forest", "en", "c"), (7, "12 ?!", None, "c")]
STAGES = [s for s in P.STAGES if s[0] != "tokens"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("int"))
    for i, name in enumerate(NAMES):
        df = df.withColumn(name, F.lit(f"mine {i}"))
    return df


@pytest.mark.parametrize("name,stage", STAGES)
def test_columns_come_back(spark, docs, name, stage):
    out = stage(spark, docs, "")
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = out.collect()
    assert got and all([r[c] for c in NAMES] == [f"mine {i}" for i in range(len(NAMES))] for r in got)
    before = {(r.doc_id, r.text, r.source) for r in docs.collect()}
    if name != "personal_data":
        assert {(r.doc_id, r.text, r.source) for r in got} <= before


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_empty_table_and_bare_columns(spark, docs, name, stage):
    assert stage(spark, docs.limit(0), "").count() == 0
    bare = docs.select("doc_id", "text", "lang", "source")
    assert stage(spark, bare, "").count() > 0


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_nulls_alone(spark, name, stage):
    df = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id bigint, text string, lang string, source string")
    assert stage(spark, df, "").count() == (0 if name in ("language_id", "mixture") else 3)


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return Counter(tuple(r) for r in P.near_duplicates(spark, df, "").collect())


def test_near_duplicates_goes_by_row(spark):
    a, b = ENGLISH.format(1), GERMAN.format(2)
    near = ENGLISH.format(2)
    assert kept(spark, [(1, a), (2, a), (2, b), (None, a), (None, a)]) == Counter([(1, a), (2, b)])
    assert kept(spark, [(None, a), (None, near), (None, b)]).total() == 2
    assert kept(spark, [(None, a), (9, near)]) == Counter([(9, near)])
    assert kept(spark, [(2, b), (2, b), (2, b)]) == Counter([(2, b)])
    assert kept(spark, [(1, None), (1, None), (2, ""), (2, " ")]) == Counter([(1, None), (1, None), (2, ""), (2, " ")])
    # Two texts under one id are two texts: neither is linked to the other's copies.
    assert kept(spark, [(1, a), (1, b), (2, near), (3, GERMAN.format(3))]) == Counter([(1, a), (1, b)])


def test_rows_that_differ_elsewhere_are_still_copies(spark):
    a = ENGLISH.format(1)
    df = spark.createDataFrame([(1, a, "x"), (1, a, "y"), (1, a, "y")], "doc_id bigint, text string, more string")
    first = P.near_duplicates(spark, df, "").collect()
    assert len(first) == 1 and P.near_duplicates(spark, df.repartition(3), "").collect() == first


def test_components_of_repeated_ids(spark):
    a, b = ENGLISH.format(1), GERMAN.format(2)
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, GERMAN.format(4)), (None, b)], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.jaccard_join(df).collect())
    assert got == Counter([(1, 1), (2, 1), (2, 2), (3, 2), (None, 2)])


@pytest.mark.parametrize("rows", [200, 50_000])
def test_batches_larger_than_a_pack(spark, rows, monkeypatch):
    """70,000 short documents in batches of 50,000: places in a pack don't wrap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(ngram_join, "bounded", lambda spark: spark)
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        df = spark.range(0, 70_000, 1, 1).selectExpr("id AS doc_id", "concat('a b c d e', id % 35000, ' x y') AS text")
        wrong = ngram_join.jaccard_join(df).where("component_id <> doc_id % 35000 OR n_shingles <> 3")
        assert wrong.count() == 0
    finally:
        spark.conf.set(key, before)


def test_hashes_do_not_depend_on_the_session(spark):
    rows = spark.createDataFrame([(i, ENGLISH.format(i % 3)) for i in range(9)], "doc_id bigint, text string")
    df = rows.withColumn("mark", F.lit(None).cast("binary"))
    key, sets = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    try:
        for parts in ("8", "300"):
            spark.conf.set(key, parts)
            found = ngram_join.classes(df)[2]
            sets.append({(r.n, bytes(r.grams)) for r in found.collect()})
    finally:
        spark.conf.set(key, before)
    assert sets[0] == sets[1] != set()
