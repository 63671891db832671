"""A training corpus from ``documents``: language, near duplicates, personal data, mixture, tokens.

Every stage works on all rows that the stage before it kept, takes (spark, docs, sf_dir) and returns a DataFrame that is
written and read again as the next one's input. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, language, mixing, ngram_join, pii
from corpusmill.llm.common import bounded, read
from corpusmill.session import materialize

#: The stages end in tokenizer output and learned models, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def aside(docs: DataFrame, *worked: str) -> DataFrame:
    """The columns that a stage works on, and all others of ``docs`` in one called row, where no name of a result meets them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in worked]
    return docs.select(*worked, *([F.struct(*rest).alias("row")] if rest else []))


def back(rows: DataFrame, like: DataFrame, *worked: str) -> DataFrame:
    """The columns of ``like`` in their order, from what ``aside`` made of them."""
    return rows.select(*[F.col(f"`{c}`") if c in worked else F.col(f"row.`{c}`") for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; null and empty texts, texts without letters and narrow margins go. Every row is
    judged by its own text, so repeated rows and ids share a fate; an empty table stays empty; all columns of ``docs``
    come back as they were, whatever they are called."""
    bounded(spark)
    return back(language.identify(aside(docs, "text"), language.fit(docs)).where(~F.col("rejected")), docs, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest doc_id. Groups are groups of texts: a text that only
    shares its doc_id with a copy stays, and copies without an id go as others do. Rows without words all stay. An empty
    table stays empty; all columns come back as they were."""
    bounded(spark)
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind in brackets. A null text stays null and an empty one empty;
    repeated rows get equal texts; n_chars, where the table has it, follows a text that isn't null; all other columns come
    back as they were."""
    bounded(spark)
    clean = back(pii.redact(aside(docs, "text"), pii.fit(docs)), docs, "text")
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture of sources takes them: not at all, or up to three times. A null source is a source; texts
    without words have no size, add nothing and come once for each whole copy of their source; a source without any words is
    not taken; repeated rows and ids are rows of their own; an empty table stays empty; all columns come back as they were."""
    bounded(spark)
    worked = ("doc_id", "text", "source")
    mixed = mixing.mix(aside(docs, *worked)).where(F.col("copies") > 0)
    return back(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, *worked)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row of the mixture. Null and empty texts have no tokens; repeated rows have equal
    ones; an empty table stays empty; other columns end here."""
    bounded(spark)
    coded = bpe.encode_decode(docs.select("doc_id", "text", "source"), bpe.default_path())
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture),
          ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
