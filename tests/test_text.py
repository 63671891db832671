"""Literal cases for screening, sentences, numbers and pages."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import scalars as S
from corpusmill.functions import screening as G
from corpusmill.functions import text as X
from corpusmill.operators import sections as E

PII = [
    ("here is my pan QWERT6789Z", "PAN"), ("pan qwert6789z please", "PAN"), ("Aadhaar: 3456-7890-1234", "Aadhaar"),
    ("number 456789012345 is linked", "Aadhaar"), ("ring 8765432109 today", "phone number"), ("it is +91 87654 32109", "phone number"),
    ("write to a.b@site.co.in", "email"), ("send it to meena@okaxis", "UPI ID"), ("OTP: 778812", "OTP / PIN / password"),
    ("mpin 4471", "OTP / PIN / password"), ("passcode=x9y8", "OTP / PIN / password"), ("acct number 60200345678", "account or folio number"),
    ("folio # 7654321/12", "account or folio number"), ("a/c 987654321", "account or folio number"),
    ("paid by 5555-5555-5555-4444", "card number"), ("id 998877665544332", "long number (account/ID)"),
]
CLEAN = [
    "Is ₹2,500 enough for a SIP?", "I put 7500 in every month", "growth in 2023 and 2024", "a 3 year lock", "gains over 1.25 lakh",
    "Section 80C applies?", "the NAV was 1432.07", "0.55% against 0.61%", "the OTP never came", "which password opens the file?",
    "what is a folio?", "it runs on the 7th", "there are 12 Cr+ users", "AUM of ₹2,31,404.50 Cr", "a limit of Rs 200000", "within 365 days",
]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize("text,kind", PII)
def test_personal_data_is_found(spark, text, kind):
    assert kind in value(spark, G.pii_types(F.lit(text)))
    assert value(spark, G.has_pii(F.lit(text)))


@pytest.mark.parametrize("text", CLEAN)
def test_ordinary_text_passes(spark, text):
    assert value(spark, G.pii_types(F.lit(text))) == []
    assert not value(spark, G.has_pii(F.lit(text)))


@pytest.mark.parametrize("text,kind", [
    ("Should we switch now?", "refuse_advice"), ("is it worth buying", "refuse_advice"), ("best acme scheme", "refuse_advice"),
    ("which fund is the better one", "refuse_advice"), ("compare the performance of A and B", "refuse_comparison"),
    ("did it beat the index", "refuse_comparison"), ("lowest returns this year", "refuse_comparison"),
    ("what is the exit load", None), ("how do I stop a SIP", None)])
def test_refusals(spark, text, kind):
    assert value(spark, G.refusal_kind(F.lit(text), ["acme"])) == kind


@pytest.mark.parametrize("text,flag", [
    ("You can choose this one.", False), ("You should choose this one.", True), ("We advise patience.", True),
    ("A smart choice overall.", True), ("It outperforms the rest.", True), ("The ratio is 0.6%.", False)])
def test_advice_in_answers(spark, text, flag):
    assert value(spark, G.gives_advice(F.lit(text))) is flag


@pytest.mark.parametrize("text,sentences", [
    ("It is ₹12.50. Load is Nil.", ["It is ₹12.50.", "Load is Nil."]),
    ("- A: 0.6%\n- B: 0.7%", ["- A: 0.6%", "- B: 0.7%"]),
    ("Do this: 1. Open it. 2. Close it. End.", ["Do this: 1. Open it.", "2. Close it.", "End."]),
    ("Pay Rs. 5 now. No. Of units is two.", ["Pay Rs. 5 now.", "No. Of units is two."])])
def test_sentences(spark, text, sentences):
    assert value(spark, X.split_sentences(F.lit(text))) == sentences


def test_finalize(spark):
    body = "One is 0.6%. Two (see https://a.example/x). Three. Four."
    out = value(spark, G.finalize_answer(F.lit(body), F.lit("https://b.example"), F.lit("2026-01-02"), "Facts only.", "https://g.example"))
    assert out.body == "One is 0.6%. Two. Three." and not out.blocked
    assert out.text == out.body + "\n\nSource: https://b.example\nLast updated from sources: 2026-01-02"
    out = value(spark, G.finalize_answer(F.lit("You must sell it."), F.lit("u"), F.lit("2026-01-02"), "Facts only.", "https://g.example"))
    assert out.blocked and out.text == "Facts only.\n\nSource: https://g.example" and out.last_updated is None
    bullets = "\n".join(f"- item {i}" for i in range(20))
    assert value(spark, X.limit_sentences(F.lit(bullets))).count("\n") == 11


def test_url_rules_run_in_order(spark):
    assert value(spark, X.strip_urls(F.lit("![alt](http://a/b) ![](http://a/c) [t](http://d) http://e  x"))) == "!alt t x"


def test_dates_and_numbers(spark):
    assert value(spark, S.utc_to_local_date(F.lit("2019-07-03T18:30:00.000Z"))) == "2019-07-04"
    assert value(spark, S.parse_number(F.lit("+7.7%"))) == 7.7
    assert value(spark, S.parse_number(F.lit("n/a"))) is None
    assert value(spark, X.extract_numbers(F.lit("₹1,000 and 0.65% and 1,000."))) == ["1000", "0.65"]


def test_faqs_stop_at_the_first_other_heading(spark):
    md = "# X\n## FAQs\n### A?\none\n\n  two\n!Looking to invest\npromo\n### B?\n### C?\nthree\n## End\n### D?\nfour"
    out = value(spark, E.extract_faqs(F.lit(md)))
    assert [(f.question, f.answer) for f in out] == [("A?", "one\ntwo"), ("C?", "three")]


def test_repeated_metric_keeps_its_last_row(spark):
    md = "## Returns and rankings\n|1Y|3Y\n-|-|-\nA|1|--\nA|2|3"
    assert [tuple(r) for r in value(spark, E.unpivot_table(F.lit(md)))] == [("A", "1Y", "2"), ("A", "3Y", "3")]


def test_help_article_status(spark):
    ok = "# Banner\n# Q? \ntext\nWas the answer helpful?\nx"
    assert value(spark, E.help_article(F.lit(ok))).asDict() == {"question": "Q?", "answer": "text", "status": "ok"}
    assert value(spark, E.help_article(F.lit("# Banner\n# Q\ntext"))).status == "failed"
    assert value(spark, E.help_article(F.lit("# Banner\ntext"))).status == "dead page"
