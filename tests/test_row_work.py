"""Steps that read each text several times over: what a text is put through now, and the same results."""

import contextlib
import io
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusmill.functions import patterns as P
from corpusmill.functions import screening as G
from corpusmill.functions import text as X
from corpusmill.operators import answers as A
from corpusmill.operators import chunking as K
from corpusmill.operators import sections as E


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def query_plan(spark, key: str) -> str:
    return plan(entry.queries()[key](spark, entry.SMOKE_DIR))


def mixed(n: int, bits: list[str], most: int = 14) -> list[str]:
    rng = random.Random(n)
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(most))) for _ in range(n)]


# ---- chunks (F13, F17, F25) ----

def test_pieces_carry_the_counts_of_their_texts(spark):
    rng, word = random.Random(5), lambda: "".join(random.Random(len(w)).choice("abcé1_") for w in ["x" * 3])
    texts = [None, "", " \n", "one line"]
    for _ in range(40):
        parts = [" ".join(rng.choice(["ab", "é_1", "x.y", "--", word()]) for _ in range(rng.choice([3, 40, 500]))) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(p + rng.choice(["\n", "\n\n", ". ", "\r\n", "\n- ", " * a\n", "\n a | b\n", "\x1f- c\n"]) for p in parts))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", K.split_counted(F.col("t")).alias("p"), K.split_body(F.col("t")).alias("s")).collect():
        assert [p.text for p in r.p] == r.s
        assert [p.n for p in r.p] == [len(re.findall(r"\w+", p.text)) for p in r.p]
        if r.t is not None and len(re.findall(r"\w+", r.t)) <= P.CHUNK_MAX_TOKENS:
            assert r.s == [r.t]


def test_chunk_sizes_come_from_their_pieces(spark):
    text = "\n\n".join(" ".join(f"w{i}" for i in range(n)) for n in (300, 900, 20))
    docs = spark.createDataFrame([(1, text), (2, "short one"), (3, None)], "id long, body string")
    got = K.chunk_table(docs, F.lit("[A b]"), K.split_counted(F.col("body")), []).collect()
    assert all(r.tokens == len(re.findall(r"\w+", r.text)) for r in got) and {r.doc_id for r in got} == {1, 2}
    # the size column of the query counts no whole chunk again
    assert "regexp_extract_all(text" not in query_plan(spark, "chunk_size_check")


# ---- sections (F19, F23) ----

@pytest.mark.parametrize("key", ["key_value_rows", "unpivot_table"])
def test_a_page_is_composed_once(spark, key):
    assert query_plan(spark, key).count("Customer Support") == 1


def test_bodies_of_headings(spark):
    pages = ["# A\n x \n## B\n\n", "#", "## b", "no heading", "x\n#A\r\nb\x85## A   c\n#a\nd", "#######  B \n y", None]
    df = spark.createDataFrame([(p,) for p in pages], "t string")
    for r in df.select("t", E.split_sections(F.col("t")).alias("s"), E.heading_text(F.col("t"), "a").alias("a"), E.heading_text(F.col("t"), "b").alias("b")).collect():
        for name, body in (("a", r.a), ("b", r.b)):
            assert body == next((s.body for s in r.s or [] if s.heading.lower() == name), None)
        if r.t is not None:
            whole = re.sub("\r\n|" + X.LINE_BREAKS, "\n", r.t)
            parts = [p for p in re.split(r"\n(?=#)", whole) if p.startswith("#")]
            assert [s.body for s in r.s] == [p.partition("\n")[2].strip() for p in parts]


# ---- articles (F18) ----

def test_a_help_page_is_built_once_and_not_again_for_the_filter(spark):
    assert query_plan(spark, "article_records").count("How to redeem") <= 2  # two forms of one page


def test_article_ends(spark):
    ends = ["## Disclaimer", "####### Disclaimer", "## Disclaimer  ", "## Disclaimer x", "Do you like this edition?", "Do you like this edition? y", " Recent Posts", "Recent Posts", "Recent Posts\t"]
    df = spark.createDataFrame([(i, f"a\n{e}\nb") for i, e in enumerate(ends)], "i int, t string")
    cut = {r.i for r in df.select("i", F.split("t", P.ARTICLE_END, 2).alias("p")).collect() if len(r.p) == 2}
    assert cut == {0, 2, 4, 5, 7, 8} and P.ARTICLE_END.count("^") == 1


def test_steps_that_are_left_out_would_change_nothing(spark):
    bits = ["[a]", "(http://x.y)", "(https://x)", "!", "[", "]", "(b)", "https://q.r/s", " ", "  ", "\n", "\n\n\n", "\t", "5 min read", "12 min read\n",
            "Loading...", "```", " \n", "word", "\n!", "\r\n"]
    df = spark.createDataFrame([(t,) for t in [*mixed(4000, bits), None]], "t string")
    plain = F.col("t")
    for _, patterns in X.URL_STEPS + X.CLEAN_STEPS:
        for pattern, to in patterns:
            plain = X.rep(plain, pattern, to)
    got = df.select("t", X.clean_text(F.col("t")).alias("got"), X.strip(plain).alias("want"))
    assert got.where("NOT (got <=> want)").collect() == []
    assert got.where("got <> t").count() > 1000


# ---- screening (F21) ----

def test_texts_left_out_of_a_screen_hold_nothing(spark):
    bits = ["ABCDE", "1234", "F", "٣٤٥٦", " ", "-", "98765", "43210", "user", "@", "okbank", ".in", "otp ", "is ", "7", "folio no ", "123456", "/", "₹", ",", "4111 1111 1111 1111",
            "word", "+91", "\n", "."]
    df = spark.createDataFrame([(t,) for t in [*mixed(6000, bits, 8), None]], "t string")
    got = df.select("t", G.has_pii(F.col("t")).alias("new"), (F.size(G.pii_types(F.col("t"))) > 0).alias("kinds"),
                    G.has_old_pii(F.col("t")).alias("old"), F.col("t").rlike(X.any_pattern(P.OLD_PII_PATTERNS)).alias("plain"))
    assert got.where("t IS NOT NULL AND NOT (new <=> kinds)").collect() == []
    assert got.where("NOT (old <=> plain)").collect() == []
    assert got.where("t IS NULL AND (new IS NOT NULL OR old IS NOT NULL)").collect() == []
    assert got.where("new").count() > 500 and got.where("old").count() > 500 and got.where("NOT new").count() > 500


def test_long_dotted_runs_without_an_at_sign_are_screened_at_once(spark):
    text = "a." * 100_000
    start = time.time()
    assert spark.range(1).select(G.has_old_pii(F.lit(text)).alias("o"), G.has_pii(F.lit(text)).alias("n")).collect()[0] == (False, False)
    assert time.time() - start < 10


# ---- answers (F14) ----

def test_word_edges_are_tested_once_a_place_with_the_same_answers(spark):
    lists = [P.ADVICE_OUT, P.COMPARISON_IN, P.OLD_PII_PATTERNS, [p.replace("{house}", "(acme )?") for p in P.ADVICE_IN]]
    assert all(p.startswith(r"\b") for ps in lists for p in ps)
    assert [X.any_word_pattern(ps).count(r"\b(?:(?:") for ps in lists] == [1] * len(lists)
    bits = ["you ", "we ", "should ", "buy", "better ", "than ", "good ", "fund", "x", " ", "outperforms", "é", "1234567890", "a@b.c", "I recommend", "compare ", "returns", "best ", "acme ", "for"]
    df = spark.createDataFrame([(t,) for t in mixed(4000, bits, 7)], "t string")
    for ps in lists:
        got = df.select(F.col("t").rlike(X.any_word_pattern(ps)).alias("got"), F.col("t").rlike(X.any_pattern(ps)).alias("want"))
        assert got.where("got <> want").count() == 0 < got.where("got").count()


def test_links_are_stripped_as_by_all_steps(spark):
    bits = ["http://a.b/c", "https://q.r).", "www.x.y", "(", "see", "via", ")", " ", "  ", "\t", ".", ",", "word", "\n", "()", "( at )", "[", "]"]
    df = spark.createDataFrame([(t,) for t in [*mixed(4000, bits), None]], "t string")
    plain = F.col("t")
    for _, patterns in G.LINK_STEPS:
        for pattern, to in patterns:
            plain = X.rep(plain, pattern, to)
    want = X.strip(X.rep(plain, r"[ \t]+([.,;:!?])", "$1"))
    assert df.select(G.strip_links(F.col("t")).alias("got"), want.alias("want")).where("NOT (got <=> want)").collect() == []


# ---- passages (F4) ----

def test_only_texts_that_are_hit_leave_their_scan(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 5, 1), (2, 99, 2)], "qid long, id long, rank int")
    texts = spark.range(50).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = A.passages(hits, texts)
    assert sorted(map(tuple, got.select("qid", "rank", "text").collect())) == [(1, 1, "t5"), (1, 2, "t7"), (2, 1, "t5")]
    assert "LeftSemi" in plan(got)
    # written hits are small here, so neither side's texts are dealt out before the rows of a query meet
    assert query_plan(spark, "format_context").count("Exchange hashpartitioning") == 1
