"""Filters and lookups by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def metadata_filter(df: DataFrame, **equal) -> DataFrame:
    """Rows whose metadata columns equal the given values; the test reaches the file scan."""
    for name, value in equal.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def point_lookup(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` for a table of keys, repeated keys once, unknown keys skipped."""
    return in_list_filter(df, keys, on)


def in_list_filter(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``key IN (list)`` where the list is a table; a semi-join needs no distinct on the list."""
    return df.join(keys.select(on), on, "left_semi")
