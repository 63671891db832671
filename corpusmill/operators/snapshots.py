"""Versions of a collection of tables: all of them change together, or none does.

Every publication writes all tables into a folder of its own. A small pointer file, replaced at the very end, names the
version that counts; readers look there. A writer that dies before that leaves a folder nobody reads. Rows and problems
are counted by observations in the pass that writes, so a valid publication reads its data once.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.publish import Rejected
from corpusmill.sources import store


@dataclass
class Checked:
    """A table with its checks: ``problems`` is an array of texts for each row (null or empty: a good row), told with ``key``."""
    rows: DataFrame
    key: str | None = None
    problems: Column | None = None


class Snapshots:
    """Published versions of a collection of tables below one folder, which every executor can reach. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def pointer(self) -> str:
        return f"{self.root}/CURRENT"

    def current(self) -> dict | None:
        """{version, tables: {name: rows}} of what is published, None before the first time."""
        text = store.read_text(self.spark, self.pointer)
        return json.loads(text) if text else None

    def path(self, table: str, version: str | None = None) -> str:
        published = self.current()
        if version is None and published is None:
            raise LookupError(f"nothing is published in {self.root}")
        return f"{self.root}/versions/{version or published['version']}/{table}"

    def read(self, table: str, version: str | None = None) -> DataFrame:
        """A table of the current version, or of a given one. Tables that must fit together are read with one version."""
        return self.spark.read.parquet(self.path(table, version))

    def counts(self) -> DataFrame:
        """(table_name, n_rows) of the current version."""
        published = self.current() or {"tables": {}}
        return self.spark.createDataFrame(sorted(published["tables"].items()), "table_name string, n_rows bigint")

    def publish(self, tables: dict[str, DataFrame | Checked]) -> dict:
        """Writes all tables as a new version and makes it the current one; returns what ``current`` then says.

        If a check finds a problem, all of them are listed in a table, the version is deleted, the pointer stays and Rejected
        is raised with the path of the list. A table that names its problems is written once, whether it passes or not.
        """
        version = uuid.uuid4().hex
        folder = f"{self.root}/versions/{version}"
        checked = {name: t if isinstance(t, Checked) else Checked(t) for name, t in tables.items()}
        rows, bad = {}, {}
        for name, table in checked.items():
            seen = Observation(f"{name}-{version}")
            problems = F.lit(0) if table.problems is None else F.greatest(F.coalesce(F.size(table.problems), F.lit(0)), F.lit(0))
            table.rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(problems).alias("problems")).write.parquet(f"{folder}/{name}")
            rows[name], bad[name] = int(seen.get["rows"]), int(seen.get["problems"] or 0)
        if any(bad.values()):
            report = f"{self.root}/rejected/{version}"
            for name in (n for n, found in bad.items() if found):
                table = checked[name]
                written = self.spark.read.schema(table.rows.schema).parquet(f"{folder}/{name}")
                written.select(F.lit(name).alias("table_name"), F.col(table.key).cast("string").alias("key") if table.key else F.lit(None).cast("string").alias("key"),
                               F.explode(table.problems).alias("problem")).write.mode("append").parquet(report)
            store.delete(self.spark, folder)
            raise Rejected(f"{sum(bad.values())} problems, listed in {report}", report)
        published = {"version": version, "tables": rows, "before": (self.current() or {}).get("version")}
        store.replace_text(self.spark, self.pointer, json.dumps(published))
        return published

    def clean(self) -> list[str]:
        """Deletes all versions but the current one and the one before it, which readers may still hold; unfinished ones too, so
        not while a writer is at work. Returns their names."""
        published = self.current() or {}
        kept = {published.get("version"), published.get("before")}
        gone = [v for v in store.folders(self.spark, f"{self.root}/versions") if v not in kept]
        for version in gone:
            store.delete(self.spark, f"{self.root}/versions/{version}")
        return gone
