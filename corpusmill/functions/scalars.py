"""Column functions over dates, numbers, ids, URLs and nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import patterns as P
from corpusmill.functions.text import rep, strip


def utc_to_local_date(c: Column, offset_minutes: int = 330) -> Column:
    """Date at a fixed offset of a UTC time such as ``2019-07-03T18:30:00.000Z``, whatever the session zone is."""
    utc = F.to_timestamp_ntz(rep(c, "Z$"))
    return F.date_format(utc + F.make_dt_interval(mins=F.lit(offset_minutes)), "yyyy-MM-dd")


def compose_duration(years: Column, months: Column, days: Column) -> Column:
    parts = [F.when(n != 0, F.concat_ws(" ", n.cast("string"), F.lit(unit)))
             for n, unit in ((years, "years"), (months, "months"), (days, "days"))]
    return F.nullif(F.array_join(F.array_compact(F.array(*parts)), " "), F.lit(""))


def parse_number(c: Column) -> Column:
    """``+7.7%``, ``1,234`` or ``₹30.5`` as a double; NULL for anything else."""
    return F.trim(rep(c, "[%+,₹]")).try_cast("double")


def null_markers(c: Column, markers: tuple[str, ...] = ("--", "")) -> Column:
    return F.when(~c.isin(*markers), c)


def grouped(c: Column) -> Column:
    """Thousands groups with the number's own decimals: 1234.5 -> 1,234.5 and 900.0 -> 900.0. A number that needs more
    than 20 digits before or 18 after the point stays as it is written."""
    plain = c.try_cast("decimal(38,18)")
    decimals = F.regexp_extract(rep(plain.cast("string"), r"(\.\d+?)0+$", "$1"), r"(\.\d+)$", 1)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    exact = plain.cast("double") == c.cast("double")
    return F.when(exact, F.concat(sign, F.format_number(F.floor(F.abs(plain)), 0), decimals)).otherwise(c.cast("string"))


def format_currency(c: Column, decimals: int | None = 0, unit: str = "") -> Column:
    """A rupee amount; ``decimals=None`` keeps the number's own decimals."""
    text = grouped(c) if decimals is None else F.format_number(c, decimals)
    return F.concat(F.lit("₹"), text, F.lit(unit))


def rupees(c: Column, dtype: T.DataType) -> Column:
    """Currency for numbers, the text itself for anything else."""
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType)):
        return format_currency(c, 0)
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return format_currency(c, None)
    return F.coalesce(c.cast("string"), F.lit("None"))


def stable_id(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.substring(F.sha1(text), 1, 16)


def raw_key(url: Column, long_prefix: str = "", short_prefix: str = "") -> Column:
    """File key of a URL: its path with ``/`` as ``__``, after shortening one known prefix."""
    path = rep(url, r"^[a-zA-Z]+://[^/]+/?")
    if long_prefix:
        path = F.replace(path, F.lit(long_prefix), F.lit(short_prefix))
    return F.replace(path, F.lit("/"), F.lit("__"))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def url_slug(url: Column) -> Column:
    """Last path segment, dashes as spaces, cut at 48 characters."""
    last = F.element_at(F.split(rep(url_path(url), "/+$"), "/", -1), -1)
    return F.substring(F.replace(last, F.lit("-"), F.lit(" ")), 1, 48)


def url_topic(url: Column, prefix: str) -> Column:
    """First path segment after a fixed prefix."""
    return F.split_part(F.when(url.startswith(prefix), F.substr(url, F.lit(len(prefix) + 1))).otherwise(url),
                        F.lit("/"), F.lit(1))


def citation_label(url: Column, title: Column, site: str | None = None) -> Column:
    """Known title cut at 60, else host and slug."""
    slug = url_slug(url)
    fallback = F.when(slug != "", F.concat(url_host(url), F.lit(" › "), slug)).otherwise(url_host(url))
    shown = F.substring(title, 1, 60)
    if site:
        shown = F.concat(F.lit(f"{site} · "), shown)
    return F.when(title != "", shown).otherwise(fallback)


def embedded_json(html: Column) -> Column:
    """Text of the page's own data script, NULL where the page has none."""
    return F.nullif(F.regexp_extract(html, P.EMBEDDED_JSON, 1), F.lit(""))


def updated_at(html: Column) -> Column:
    """Ten-character date of the post, from the embedded data."""
    value = F.get_json_object(embedded_json(html), "$.props.pageProps.blogData.updated_at")
    return F.nullif(F.substring(value, 1, 10), F.lit(""))


def trim_all(c: Column, dtype: T.DataType) -> Column:
    """Trim every string inside a nested value; the expression follows the schema, so no rows are inspected."""
    if isinstance(dtype, T.StringType):
        return strip(c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: trim_all(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: trim_all(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [trim_all(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def label_map(c: Column, labels: dict[str, str]) -> Column:
    """Label of a known value, the value itself otherwise."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), c)


def heading_path(*headings: Column) -> Column:
    """``page > parent > heading`` without empty entries and without repeats of the entry before."""
    path = F.array_compact(F.array(*[F.nullif(h, F.lit("")) for h in headings]))
    kept = F.aggregate(
        path, F.array().cast("array<string>"),
        lambda acc, h: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == h), acc)
        .otherwise(F.concat(acc, F.array(h))))
    return F.array_join(kept, " > ")


def l2_to_cosine(squared_distance: Column) -> Column:
    """Cosine of unit vectors from their squared distance."""
    return 1 - squared_distance / 2
