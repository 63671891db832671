"""Embedded payloads of any shape: parsed once into a variant, read by path, and compared with the shape that is expected.

A fixed schema reads what it knows and turns everything else into nulls. Here what is missing, of another type, new or
no JSON at all becomes a problem row, so that a page whose payload has changed is told from one that has no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.scalars import embedded_json
from corpusmill.functions.text import let

PROBLEM = "array<struct<path:string,problem:string>>"


def payload(html: Column, root: str = "$") -> Column:
    """The page's data script as a variant, or the part of it at ``root``; null where there is none or it is no JSON."""
    return F.try_variant_get(F.try_parse_json(embedded_json(html)), root, "variant")


def kind_of_type(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "object"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "number" if isinstance(kind, T.NumericType) else "string"


def kind_of(value: Column) -> Column:
    """What a variant holds: object, array, string, boolean, number or null."""
    name = F.schema_of_variant(value)
    return (F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number"))


def problem(path: Column | str, text: Column | str) -> Column:
    to = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.array(F.struct(to(path).alias("path"), to(text).alias("problem")))


def differences(value: Column, expected: T.DataType, path: str = "$", optional: bool = True) -> Column:
    """array<struct<path,problem>>: how a variant differs from the expected type. A null is no difference; a field that is not
    there is one unless ``optional`` fields may lack; numbers are one kind. Elements of an array count once for each
    path and problem."""
    none, kind = F.array().cast(PROBLEM), kind_of_type(expected)

    def inside(v: Column) -> Column:
        if isinstance(expected, T.ArrayType):
            found = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: differences(x, expected.elementType, f"{path}[*]", optional))
            return F.array_distinct(F.flatten(found))
        if not isinstance(expected, T.StructType):
            return none
        names = [f.name for f in expected.fields]

        def fields(keys: Column) -> Column:
            def of(f: T.StructField) -> Column:
                at = f"{path}.{f.name}"
                have = let(F.try_variant_get(v, f'$["{f.name}"]', "variant"), lambda x: differences(x, f.dataType, at, optional))
                return F.when(F.array_contains(keys, f.name), have).otherwise(none if optional else problem(at, "missing"))

            new = F.transform(F.array_except(keys, F.array(*[F.lit(n) for n in names])), lambda k: F.struct(
                F.concat(F.lit(f"{path}."), k).alias("path"), F.lit("unknown field").alias("problem")))
            return F.flatten(F.array(*[of(f) for f in expected.fields], new))

        return let(F.json_object_keys(F.to_json(v)), fields)

    def told(found: Column) -> Column:
        return F.when(found == "null", none).when(found != kind, problem(path, F.concat(F.lit(f"{kind} expected, "), found, F.lit(" found")))).otherwise(inside(value))

    return F.when(value.isNull(), none).otherwise(let(kind_of(value), told))


def payload_problems(pages: DataFrame, key: str, html: Column, expected: str | T.StructType, root: str = "$", optional: bool = False) -> DataFrame:
    """(key, path, problem): one row for each way in which a page's payload is not the expected one. Pages without a script, whose
    script is no JSON, or that have nothing at ``root`` have one row that says so. Nulls are values."""
    kind = pages.sparkSession.createDataFrame([], expected).schema if isinstance(expected, str) else expected

    def checked(raw: Column) -> Column:
        return let(F.try_parse_json(raw), lambda v: F.when(raw.isNull(), problem("$", "no payload")).when(v.isNull(), problem("$", "no JSON")).otherwise(
            let(F.try_variant_get(v, root, "variant"), lambda part: F.when(part.isNull(), problem(root, "missing")).otherwise(
                differences(part, kind, root, optional)))))

    found = pages.select(key, F.explode(let(embedded_json(html), checked)).alias("p"))
    return found.select(key, "p.path", "p.problem")


def payload_shapes(pages: DataFrame, html: Column, root: str = "$", by: str | None = None) -> DataFrame:
    """(by, pages, shape): the union of the shapes of all payloads, in one aggregate."""
    shaped = pages.select(*([by] if by else []), payload(html, root).alias("v"))
    return shaped.groupBy(*([by] if by else [])).agg(F.count("v").alias("pages"), F.schema_of_variant_agg("v").alias("shape"))
