"""Column functions that screen messages and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions.text import any_word_pattern, let, limit_sentences, rep, stepwise, strip


def has_card(c: Column) -> Column:
    """Any 13 to 19 digits, spaces and dashes allowed, that pass the checksum."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(P.CARD_RUN), 0), lambda r: rep(r, r"(?U)\D"))
    return F.exists(runs, lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def pii_types(c: Column) -> Column:
    """Kinds of personal data found, in fixed order; the values themselves are never kept."""
    flags = [F.when(c.rlike(pattern), F.lit(kind)) for kind, pattern in P.PII_PATTERNS.items()]
    flags.append(F.when(has_card(c), F.lit(P.CARD_KIND)))
    return F.array_compact(F.array(*flags))


def has_pii(c: Column) -> Column:
    """Texts without an ``@`` and without digits, as nearly all are, are looked at by two plain searches only."""
    def any_of(kinds: list[str], more: Column) -> Column:
        return reduce(lambda found, kind: found | c.rlike(P.PII_PATTERNS[kind]), kinds, more)

    digits = [k for k in P.PII_PATTERNS if k not in P.PII_WITH_AT + P.PII_WITH_RUN]
    addresses = F.contains(c, F.lit("@")) & any_of(P.PII_WITH_AT, F.lit(False))
    numbers = any_of(digits, c.rlike(P.DIGIT_RUN) & any_of(P.PII_WITH_RUN, F.lit(False))) | has_card(c)
    return addresses | (c.rlike(P.DIGIT) & numbers)


def has_old_pii(c: Column) -> Column:
    return (F.contains(c, F.lit("@")) | c.rlike(P.DIGIT_RUN)) & c.rlike(any_word_pattern(P.OLD_PII_PATTERNS))


def pii_placeholder(c: Column) -> Column:
    return F.when(has_pii(c), F.lit(P.PII_PLACEHOLDER)).otherwise(c)


def advice_pattern(house_names: list[str] | None = None) -> str:
    names = "|".join(f"{n} " for n in house_names or [])
    house = f"({names})?" if names else ""
    return any_word_pattern([p.replace("{house}", house) for p in P.ADVICE_IN])


def refusal_kind(c: Column, house_names: list[str] | None = None) -> Column:
    """``refuse_comparison`` before ``refuse_advice``; NULL when the question may be answered."""
    return F.when(c.rlike(any_word_pattern(P.COMPARISON_IN)), F.lit("refuse_comparison")).when(
        c.rlike(advice_pattern(house_names)), F.lit("refuse_advice"))


def gives_advice(c: Column) -> Column:
    return c.rlike(any_word_pattern(P.ADVICE_OUT))


def multi_part_gate(c: Column) -> Column:
    return c.rlike(P.MULTI_PART)


# Steps as in ``text.CLEAN_STEPS``.
LINK_STEPS = [
    (["http", "www."], [(r"(?U)https?://[^\s)\]]+[^\s)\].,;:!?]|www\.[^\s)\]]+[^\s)\].,;:!?]", "")]),
    (["("], [(r"(?U)\(\s*(?:see|at|via|link)?\s*\)", "")]),
    (["  ", "\t"], [(r"[ \t]{2,}", " ")]),
]


def strip_links(c: Column) -> Column:
    return strip(rep(stepwise(c, LINK_STEPS), r"[ \t]+([.,;:!?])", "$1"))


def finalize_answer(body: Column, url: Column, last_updated: Column,
                    fallback_text: str, fallback_url: str) -> Column:
    """Answer in its one shape: short body, one source link, a date when built from sources."""
    def shaped(blocked: Column, said: Column) -> Column:
        shown = F.when(blocked, F.lit(fallback_text)).otherwise(said)
        return let(limit_sentences(strip_links(shown)), lambda text: closed(text, blocked))

    def closed(text: Column, blocked: Column) -> Column:
        cite = F.when(blocked, F.lit(fallback_url)).otherwise(url)
        date = F.when(~blocked, F.nullif(last_updated, F.lit("")))
        footer = F.concat(F.lit("\n\nSource: "), cite,
                          F.coalesce(F.concat(F.lit("\nLast updated from sources: "), date), F.lit("")))
        return F.struct(F.concat(text, footer).alias("text"), text.alias("body"), cite.alias("citation_url"),
                        date.alias("last_updated"), blocked.alias("blocked"))

    return let(body, lambda said: let(F.coalesce(gives_advice(said), F.lit(False)), lambda blocked: shaped(blocked, said)))
