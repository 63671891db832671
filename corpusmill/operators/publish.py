"""Checked writes: publish only valid data, rebuild tables, replace children, skip unchanged inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import scratch_path


class Rejected(Exception):
    """Data that failed its checks; nothing was written. ``report``: path of the table of all problems, if there is one."""

    def __init__(self, message: str, report: str | None = None):
        super().__init__(message)
        self.report = report


def publish_if_valid(problems: DataFrame, write: Callable[[], None], report: str | None = None) -> None:
    """Run ``write`` only when there is no problem row.

    Problems are evaluated once, into a table at ``report`` (the shared folder by default) that lists every one; the
    rejection says how many there are and where, and has the table's path as ``report``.
    """
    path, seen = report or scratch_path(problems.sparkSession, "problems"), Observation()
    problems.observe(seen, F.count(F.lit(1)).alias("found")).write.mode("overwrite").parquet(path)
    found = seen.get["found"]
    if found:
        raise Rejected(f"{found} problems, listed in {path}", path)
    write()


def rebuild_tables(spark: SparkSession, tables: dict[str, DataFrame], database: str | None = None,
                   path: str | None = None) -> DataFrame:
    """Replace all tables of a collection together and report their row counts: readers of ``snapshots.Snapshots(spark, path)``
    see all old tables until all new ones are written, whatever happens in between.

    ``database``: its views of these names are pointed at the new version afterwards, one by one; who needs tables that fit
    together reads the snapshots.
    """
    from corpusmill.operators.snapshots import Snapshots
    collection = Snapshots(spark, path or scratch_path(spark, "tables"))
    version = collection.publish(tables)["version"]
    for name in tables if database else ():
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM parquet.`{collection.path(name, version)}`")
    return collection.counts()


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children after a reload: those of reloaded keys are dropped, then the new ones added."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def digest_sums(columns: list[str], salt: str = "") -> list[Column]:
    """n, high and low: row count and two order-free sums of row digests, as aggregates."""
    text = F.concat_ws("\x1f", F.lit(salt), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    digest = F.sha1(text)
    high = F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)")
    low = F.conv(F.substring(digest, 13, 12), 16, 10).cast("decimal(38,0)")
    return [F.count("*").alias("n"), F.sum(high).cast("string").alias("high"), F.sum(low).cast("string").alias("low")]


def content_fingerprint(df: DataFrame, columns: list[str], salt: str = "") -> DataFrame:
    """Row count and digest sums: equal content, equal fingerprint, in one partial aggregate."""
    return df.agg(*digest_sums(columns, salt))


def is_up_to_date(spark: SparkSession, info_path: str, fingerprint: DataFrame, model: str) -> bool:
    """True when the stored info names the same content and the same model."""
    try:
        fields = [*fingerprint.schema.fields, T.StructField("model", T.StringType())]
        stored = spark.read.schema(T.StructType(fields)).json(info_path).where(F.col("model") == model)
        return not stored.join(fingerprint, fingerprint.columns, "left_semi").isEmpty()
    except AnalysisException as error:  # no info written yet
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def store_fingerprint(info_path: str, fingerprint: DataFrame, model: str) -> None:
    fingerprint.withColumn("model", F.lit(model)).write.mode("overwrite").json(info_path)


def require_model(spark: SparkSession, info_path: str, model: str) -> None:
    """Refuse vectors that another model made."""
    if spark.read.json(info_path).where(F.col("model") == model).isEmpty():
        raise Rejected(f"these vectors were not made by {model}; rebuild them")
