"""Session settings and the few helpers that depend on the cluster."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest block of query vectors that one task holds.
BROADCAST_BYTES = 64 * 1024 * 1024
SCRATCH: list[str] = []
NO_FILTER_BEFORE_EXPLODE = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def build_session(app: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Session-level settings every operator relies on; cluster sizing is left to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # An explode of a computed array would be preceded by a filter that computes the whole array once more, and that
    # filter moves into the scan stage. Here arrays are whole parsed documents, so the filter costs more than it saves.
    excluded = spark.conf.get("spark.sql.optimizer.excludedRules", None) or ""
    if NO_FILTER_BEFORE_EXPLODE not in excluded:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(filter(None, [excluded, NO_FILTER_BEFORE_EXPLODE])))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one the cluster names in spark.checkpoint.dir. Only a local master, where
    driver and tasks are one process, gets a temporary one, which goes when the process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; intermediate tables are written there")
        # A second call in this session finds the folder the first one set.
        named = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this process has written; call it when no result that reads them is needed
    any more. Returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
