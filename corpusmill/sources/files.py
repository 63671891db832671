"""File sources and sinks of the corpus jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.scalars import url_topic
from corpusmill.sources.json_arrays import scan_large_arrays


def scan_json_array(spark: SparkSession, path: str, schema, whole: int = 128 * 1024 * 1024) -> DataFrame:
    """Files that each hold one JSON array, as rows. Files of at most ``whole`` bytes are read by one task each, larger ones by as
    many as they have splits."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    large = [r.path for r in listed.where(F.col("length") > whole).collect()]  # one name a large file
    small = [r.path for r in listed.where(F.col("length") <= whole).collect()] if large else [path]
    read = spark.read.schema(schema).option("multiLine", True)
    rows = read.json(small) if small else None
    if large:
        split = scan_large_arrays(spark, large, schema)
        rows = split if rows is None else rows.unionByName(split)
    return rows


def scan_jsonl(spark: SparkSession, path: str, schema, recursive: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", recursive).json(path)


def scan_whole_text(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Every file with a suffix as one row, keyed by its name without the suffix; an error when there is none."""
    df = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    if df.isEmpty():
        raise FileNotFoundError(f"no *{suffix} files in {path}")
    return df.select(F.expr(f"left(file_name, length(file_name) - {len(suffix)})").alias("key"), "text")


def scan_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def sink_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sink_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One directory per value of ``by``. Rows are rebalanced by it: a value of many rows gets as many writers as its size
    asks for, and small values share one."""
    df.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).json(path)


def sink_csv_sorted(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """CSV with a header, columns and rows in fixed order; the sort is a range shuffle, so files follow each other."""
    (df.select(*columns).orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_files(df: DataFrame, path: str, name: str, text: str) -> None:
    """One file per row, named by a column, through the file system the path names."""
    def export(rows):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{root}/{row[name]}") as out:
                out.write(row[text].encode("utf-8"))

    df.select(name, text).foreachPartition(export)


def sitemap_urls(df: DataFrame, xml: Column, prefix: str) -> DataFrame:
    """Distinct URLs of all ``<loc>`` entries under a prefix, in order, with their topic."""
    locs = F.regexp_extract_all(xml, F.lit(r"(?U)<loc>\s*([^<\s]+)\s*</loc>"), 1)
    urls = df.select(F.explode(locs).alias("url")).where(F.col("url").startswith(prefix)).distinct()
    return urls.select("url", url_topic(F.col("url"), prefix).alias("topic")).orderBy("url")
