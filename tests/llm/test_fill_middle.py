"""Fill-in-the-middle: odd input, cuts against a loop over units, the way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import fill_middle

KIND = "doc_id bigint, text string, n string, d string, form string"


def by_hand(doc_id, text):
    """n, form, prefix, middle and output, unit by unit."""
    text = text or ""
    units = [m[0] for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_against_units_one_by_one(spark):
    rng = random.Random(11)
    parts = ["a", "Bé", "😀", " ", "  ", "\t\n", "\x0b", " ", " ", "<", "<P", "S>", ">", "\x1c", "x y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(600)]
    texts += ["<P>", "a <S> b", "x<M>", "", None, "   ", "word", " ".join(f"w{i}" for i in range(60_000)), " " * 100_000, "z" * 300_000]
    rows = [(None if i % 50 == 49 else i % 500, t, "mine", "mine", "mine") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, KIND).withColumn("output", F.lit("mine"))
    made = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "text", "d", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = made.collect()
    assert len(got) == len(rows) and {r.d for r in got} == {"mine"} and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text) and r.back == (r.text or "")


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(7, "one two three")] * 3, "doc_id bigint, text string")
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0
    assert len({tuple(r) for r in fill_middle.fill_in_middle(df).collect()}) == 1


def test_other_marks_and_rates(spark):
    df = spark.createDataFrame([(i, f"a{i} b c d") for i in range(50)], "doc_id bigint, text string")
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    rows = fill_middle.fill_in_middle(df, rate=100, suffix_first=0, marks=marks)
    got = rows.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.form == "psm" and r.back == r.text and r.output.startswith("<|prefix|>") for r in got)
    assert all(r.form == "plain" for r in fill_middle.fill_in_middle(df, rate=0).collect())
    for bad in (("aa", "b", "c"), ("<P", "P>", "<M>"), ("", "x", "y"), ("<P>", "<P><", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(df, marks=bad)
