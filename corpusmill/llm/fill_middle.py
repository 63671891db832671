"""Fill-in-the-middle by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` with the regex library keeps the end of every repetition of its group, so ``ends(1)`` holds
the number of units and every place where a text may be cut. The two cuts are looked up in that list; nothing is searched
or counted a second time. Seeds, forms, the pieces, the output and the way back are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded, others

#: White space belongs to the word behind it; at the end of a text it is a unit of its own.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: Marks of prefix, suffix and middle. None of them overlaps itself or another one, so their first places in an output are theirs.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of texts that are cut, and of these, percent whose suffix comes first.
RATE, SUFFIX_FIRST = 50, 80
PLAIN, PSM, SPM = "plain", "psm", "spm"
MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]


def cuts(text: str, first: int, second: int, units: regex.Pattern) -> tuple[int, int, int]:
    """Number of units, and the two cut offsets: the ends of ``first`` and ``second`` units modulo one more than the number."""
    ends = units.fullmatch(text).ends(1)
    n = len(ends)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0


def seeded(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the digest of ``seed:doc_id``; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """The marks, if the first place of each in an output is where it was put: no end of one may begin another."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks {a!r} and {b!r} overlap; outputs could not be taken apart")
    return marks


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
                   marks: tuple[str, str, str] = MARKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (units), form (``plain``, ``psm`` or ``spm``), prefix_chars, middle_chars and output. Rows stay where
    they are.

    A null or empty text has no units and is plain, its output the empty text. A text that holds a mark is plain, so the way
    back is exact. Plain rows have null prefix_chars and middle_chars. Rows that repeat an id and text get equal results, a
    null id is seeded as the empty text, an empty table stays empty, and input columns with the names of results are replaced.
    """
    bounded(docs.sparkSession)
    first_mark, suffix_mark, middle_mark = checked(marks)

    @F.arrow_udf("n bigint, prefix_end bigint, middle_end bigint")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        units = regex.compile(f"({UNIT})*+")
        for texts, one, other in batches:
            found = [cuts(t, a, b, units) for t, a, b in zip(texts.to_pylist(), one.to_pylist(), other.to_pylist())]
            table = np.array(found, dtype=np.int64).reshape(-1, 3)
            yield pa.StructArray.from_arrays([pa.array(c) for c in table.T], ["n", "prefix_end", "middle_end"])

    h1, h2, h3, h4 = seeded(F.col(f"`{doc_id}`"), seed)
    # All columns of the input travel in one, so that none meets the names used here.
    rows = docs.select(others(docs, MADE).alias("d"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), h1.alias("h1"), h2.alias("h2"),
                       (h3 % 100 < rate).alias("chosen"), (h4 % 100 < suffix_first).alias("turned"))
    marked = F.contains("t", F.lit(first_mark)) | F.contains("t", F.lit(suffix_mark)) | F.contains("t", F.lit(middle_mark))
    form = F.when((F.col("t") == "") | ~F.col("chosen") | marked, PLAIN).when(F.col("turned"), SPM).otherwise(PSM)
    rows = rows.select("d", "t", form.alias("form"), cut("t", "h1", "h2").alias("c"))
    start, end = F.col("c.prefix_end"), F.col("c.middle_end")
    prefix = F.substring("t", F.lit(1), start.cast("int"))
    middle = F.substring("t", (start + 1).cast("int"), (end - start).cast("int"))
    suffix = F.substring("t", (end + 1).cast("int"), F.length("t"))
    p, s, m = (F.lit(x) for x in marks)
    output = (F.when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle))
              .when(F.col("form") == SPM, F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("t")))
    cut_up = F.col("form") != PLAIN
    return rows.select("d.*", F.col("c.n").alias("n"), "form", F.when(cut_up, start).alias("prefix_chars"),
                       F.when(cut_up, end - start).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of ``fill_in_middle`` was made of, from the output and its form alone."""
    first_mark, suffix_mark, middle_mark = marks

    def between(mark: str, next_mark: str) -> Column:
        begin = F.instr(output, F.lit(mark)) + len(mark)
        return F.substring(output, begin, F.instr(output, F.lit(next_mark)) - begin)

    middle = F.substring(output, F.instr(output, F.lit(middle_mark)) + len(middle_mark), F.length(output))
    psm = F.concat(between(first_mark, suffix_mark), middle, between(suffix_mark, middle_mark))
    spm = F.concat(between(first_mark, middle_mark), middle, between(suffix_mark, first_mark))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
