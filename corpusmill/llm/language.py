"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language gets a zstandard raw-content dictionary of sample text. A text is cut into pieces of a few thousand bytes,
so that a long one keeps leaning on the dictionary and not on itself, and every piece of the whole text is counted.
Only letters matter, in lower case: marks and digits say nothing of the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import append

#: Bound of the labelled sample a model is fitted on: documents of each language, characters of each (from its middle),
#: and bytes of each dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 300, 2000, 64 * 1024
#: Languages that are learned at most, and how many times the sample is cut from the table before it is put in order.
LANGUAGES, SPARE = 256, 4
DRAWS = 2**52
PIECE_BYTES = 3000
LEVEL = 6
NO_LETTERS = re.compile(r"[\W\d_]+")
#: A text is rejected when the best language saves less than this share of the second best's size.
MARGIN = 0.002
UNKNOWN = "und"


def fit(docs: DataFrame, where: Column | None = None, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
        dictionary_bytes: int = DICTIONARY_BYTES, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Dictionaries by language from rows (doc_id, text, lang) with a language and text. The sample is seeded by doc_id and text
    and at most ``sample_docs * sample_chars`` characters a language, whatever the table's size; at most ``languages`` languages
    are learned, those of the most rows. Rows that repeat an id and text are drawn once.

    A share of each language's rows, by the number of its different ones, is cut by their draw before anything is put in
    order, so neither a language of most rows nor a row that is repeated often meets in one task.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn(
        "draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(DRAWS)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("draw").alias("different"))
    shares = F.broadcast(counts.orderBy(F.desc("n"), "lang").limit(languages).select(  # at most ``languages`` rows
        "lang", (F.lit(SPARE * sample_docs * DRAWS) / F.col("different")).alias("cut")))
    start = F.greatest(F.lit(1), F.floor((F.length("text") - sample_chars) / 2) + 1).cast("int")
    drawn = rows.join(shares, "lang").where(F.col("draw") < F.col("cut")).select(
        "lang", "draw", F.substring(F.col("text"), start, F.lit(sample_chars)).alias("sample")).groupBy("lang", "draw").agg(F.min("sample").alias("sample"))
    first = drawn.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("draw"))).where(F.col("n") <= sample_docs)
    samples: dict[str, list] = {}
    for r in first.select("lang", "n", "sample").toLocalIterator():
        samples.setdefault(r.lang, []).append((r.n, r.sample))
    joined = {lang: letters(" ".join(s for _, s in sorted(found))) for lang, found in samples.items()}
    return {lang: joined[lang][-dictionary_bytes:] for lang in sorted(joined)}


def letters(text: str) -> bytes:
    return (" " + NO_LETTERS.sub(" ", text.lower()) + " ").encode("utf-8", "surrogatepass")


class Compressors:
    """One compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard
        self.names = list(dictionaries)
        self.each = []
        for data in dictionaries.values():
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False))

    def sizes(self, text: str) -> np.ndarray:
        data = letters(text)
        pieces = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return np.array([sum([len(c.compress(p)) for p in pieces]) for c in self.each])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected. The score is the share that the best dictionary saves against the
        second best; ties go to the first name. No letter: undetermined and rejected. A single language is never rejected."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        second = int(np.partition(sizes, 1)[1])
        score = (second - int(sizes[best])) / second
        return self.names[best], score, score < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string, score double and rejected boolean. Rows stay where they are.

    Null texts, empty texts and texts without letters are ``und``, score 0, rejected; so is everything when nothing was
    learned. Repeated rows get equal results, an empty table stays empty, input columns with these names are replaced.
    """
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Compressors(dictionaries)
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return append(docs, told.asNondeterministic()(F.col(text)), ["lang_pred", "score", "rejected"])
