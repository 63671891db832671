"""Steps whose memory, copies or shuffles grew with whole tables: what their plans move, and the same results."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusmill.operators import answers as A
from corpusmill.operators import entities
from corpusmill.operators import facts as O
from corpusmill.plans import facts as PF
from corpusmill.plans import retrieval as PR
from corpusmill.plans.registry import Tables


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, entry.SMOKE_DIR)


def test_first_schemes_of_a_field_are_kept_without_sorting_all(tables):
    lists = PF.requests(tables).select(F.to_json("fact_fields").alias("qid"), "fact_fields").distinct()
    first = O.every_cross(lists, PF.facts_from_part(tables), 12)
    assert "TakeOrderedAndProject" in plan(first) and "WindowGroupLimit" not in plan(first)
    # No list asks for a known field.
    assert O.every_cross(lists.withColumn("fact_fields", F.array(F.lit("colour"))), PF.facts_from_part(tables), 12).count() == 0


@pytest.mark.parametrize("few", [0, 4096])
def test_many_questions_of_one_list_meet_its_answer(tables, monkeypatch, few):
    monkeypatch.setattr(A, "FEW_LISTS", few)
    asked = tables.orders.select(F.col("o_orderkey").alias("qid"), F.when(F.col("o_orderkey") >= 0, F.array(F.lit("nav"))).alias("fact_fields"))
    told = A.answer_every_scheme(asked, PF.facts_from_part(tables), A.House())
    assert told.count() == asked.count() and told.select("text").distinct().count() == 1
    assert ("BroadcastHashJoin" in plan(told)) or not few


def test_a_short_list_of_aliases_is_sent_to_the_words(spark):
    aliases = spark.createDataFrame([("a", "red fox"), ("b", "fox")], "entity_id string, alias string").repartition(3)
    messages = spark.createDataFrame([(i, f"The red fox {i}") for i in range(9)], "id bigint, m string").repartition(3)
    hits = entities.alias_hits(messages, aliases, "id", "m")
    assert "BroadcastHashJoin [head" in plan(hits)
    assert {(r.id, r.entity_id, r.pos) for r in hits.collect()} == {(i, e, p) for i in range(9) for e, p in (("a", 1), ("b", 2))}


def test_no_text_goes_through_the_join_with_vectors(tables):
    assert "text" not in plan(PR.chunks(tables)) and {"id", "key", "vec"} <= set(PR.chunks(tables).columns)
