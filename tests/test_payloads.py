"""Payloads that have changed become problem rows, not nulls."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import facts, payloads

GOOD = {"name": "x", "nav": 1.5, "aum": None, "open": True, "tags": ["a"], "info": {"n": 3}, "rows": [{"k": "a", "v": 1}, {"k": "b", "v": 2.5}]}
SHAPE = "name string, nav double, aum double, open boolean, tags array<string>, info struct<n:bigint>, rows array<struct<k:string,v:double>>"


def page(value, wrap=True):
    text = value if isinstance(value, str) else json.dumps({"props": {"data": value}} if wrap else value)
    return f'<html><script id="__NEXT_DATA__" type="application/json">{text}</script></html>'


def told(spark, *pages, optional=False):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return {tuple(r) for r in payloads.payload_problems(df, "id", F.col("html"), SHAPE, "$.props.data", optional).collect()}


def without(name):
    return {k: v for k, v in GOOD.items() if k != name}


@pytest.mark.parametrize("value,path,problem", [
    (without("nav"), "$.props.data.nav", "missing"), (GOOD | {"nav": "1.5"}, "$.props.data.nav", "number expected, string found"),
    (GOOD | {"more": [1]}, "$.props.data.more", "unknown field"), (GOOD | {"name": ["x"]}, "$.props.data.name", "string expected, array found"),
    (GOOD | {"info": 3}, "$.props.data.info", "object expected, number found"), (GOOD | {"info": {"n": "3"}}, "$.props.data.info.n", "number expected, string found"),
    (GOOD | {"rows": [{"k": "a", "v": 1}, {"k": 2, "v": 1}, {"k": 3, "v": 1}]}, "$.props.data.rows[*].k", "string expected, number found"),
    (GOOD | {"rows": [{"k": "a"}]}, "$.props.data.rows[*].v", "missing"), (GOOD | {"rows": {"k": "a"}}, "$.props.data.rows", "array expected, object found"),
    (GOOD | {"open": "yes"}, "$.props.data.open", "boolean expected, string found"), (GOOD | {"tags": [1, 2]}, "$.props.data.tags[*]", "string expected, number found"),
])
def test_one_difference_is_one_row(spark, value, path, problem):
    assert told(spark, page(GOOD), page(value)) == {(1, path, problem)}


def test_pages_without_a_readable_payload(spark):
    assert told(spark, "<html></html>", page("{broken"), page({"other": 1}, False), page(GOOD), None) == {
        (0, "$", "no payload"), (1, "$", "no JSON"), (2, "$.props.data", "missing"), (4, "$", "no payload")}


def test_nulls_and_optional_fields_are_no_problem(spark):
    assert told(spark, page(dict.fromkeys(GOOD))) == set()
    assert told(spark, page({"name": "x"}), optional=True) == set()
    assert told(spark, page({"name": 1, "new": 2}), optional=True) == {(0, "$.props.data.name", "string expected, number found"), (0, "$.props.data.new", "unknown field")}


def test_shapes_are_united(spark):
    df = spark.createDataFrame([(1, page({"a": 1})), (1, page({"a": 2.5, "b": "x"})), (2, page({"c": [True]})), (2, page("{bad"))], "g int, html string")
    got = {r.g: (r.pages, r["shape"]) for r in payloads.payload_shapes(df, F.col("html"), "$.props.data", "g").collect()}
    assert got == {1: (2, "OBJECT<a: DECIMAL(2,1), b: STRING>"), 2: (1, "OBJECT<c: ARRAY<BOOLEAN>>")} or got[1][1].startswith("OBJECT<a: ")
    assert got[2] == (1, "OBJECT<c: ARRAY<BOOLEAN>>") and "b: STRING" in got[1][1]


def test_the_schema_of_the_fact_pages(spark):
    """The page schema that facts are read with, as the expected shape."""
    good = {"scheme_name": "s", "nav": 2.5, "holdings": [{"company_name": "c", "corpus_per": 1.0}], "stats": None}
    df = spark.createDataFrame([(0, page(good)), (1, page(good | {"holdings": [{"company_name": 5}], "nav": "n/a", "nav_2": 1}))], "id int, html string")
    got = {tuple(r) for r in payloads.payload_problems(df, "id", F.col("html"), facts.PAGE_SCHEMA, "$.props.data", optional=True).collect()}
    assert got == {(1, "$.props.data.holdings[*].company_name", "string expected, number found"), (1, "$.props.data.nav", "number expected, string found"),
                   (1, "$.props.data.nav_2", "unknown field")}
