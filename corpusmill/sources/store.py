"""Small files and folder names of any file system that Spark reaches, through its own file-system layer."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return bool(fs.exists(at))


def delete(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return bool(fs.delete(at, True))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none where there is no such folder."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text, or None where there is none."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file so that readers see the old text or the new one and nothing between: it is written beside its place
    and moved there over the old one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, fs = _at(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    place = fs.makeQualified(at)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(fs.makeQualified(beside), place, over)
