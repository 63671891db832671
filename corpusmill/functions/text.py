"""Column functions over text: cleaning, tokens, sentences, numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P


def rep(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it as often as ``body`` likes."""
    return F.transform(F.array(value), body)[0]


# Every character that counts as white space at the edge of a text.
SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                          0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAKS = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BREAK_MARKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only spaces; looks at the two ends only."""
    return F.btrim(c, F.lit(SPACE))


def holds(c: Column, *marks: str) -> Column:
    """Whether a text holds any of the marks: a plain search, cheaper than a pattern that finds nothing."""
    return reduce(lambda found, mark: found | F.contains(c, F.lit(mark)), marks[1:], F.contains(c, F.lit(marks[0])))


def unix_lines(c: Column) -> Column:
    """Every line break as ``\\n``, so that later patterns need to know only one."""
    return let(c, lambda x: F.when(holds(x, *BREAK_MARKS), rep(x, rf"\r\n|{LINE_BREAKS}", "\n")).otherwise(x))


def lines(c: Column) -> Column:
    return F.split(unix_lines(c), "\n", -1)


# Steps in order: marks without one of which no pattern of the step finds anything, then patterns and what they become.
URL_STEPS = [
    (["](http"], [(r"\[([^\]]+)\]\(https?://[^\)]+\)", "$1"), (r"!\[([^\]]*)\]\(https?://[^\)]+\)", "$1")]),
    (["http"], [(r"(?U)https?://[^\s\)]+", "")]),
    (["  "], [(r"  +", " ")]),
    (["\n\n\n"], [(r"\n\n\n+", "\n\n")]),
]
CLEAN_STEPS = [
    (["]("], [(r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1")]),
    (["!"], [(r"(?dm)^!.*$", "")]),
    (["min read"], [(r"(?dmU)^\d+ min read$", "")]),
    (["Loading...", "```"], [(r"(?dmU)^(Loading\.\.\.|```)\s*$", "")]),
    ([" \n", "\t\n", "\n ", "\n\t"], [(r"[ \t]*\n[ \t]*", "\n")]),
    (["\n\n\n"], [(r"\n{3,}", "\n\n")]),
]


def stepwise(c: Column, steps: list) -> Column:
    """Replacements in order, each step only on texts that hold one of its marks."""
    def step(acc: Column, marks: list[str], patterns: list) -> Column:
        return let(acc, lambda x: F.when(holds(x, *marks), reduce(lambda y, p: rep(y, *p), patterns, x)).otherwise(x))

    return reduce(lambda acc, s: step(acc, *s), steps, c)


def strip_urls(c: Column) -> Column:
    """Links and images to their text, bare URLs away, white space collapsed; the order of the steps counts."""
    return stepwise(c, URL_STEPS)


def clean_text(c: Column) -> Column:
    return strip(stepwise(strip_urls(c), CLEAN_STEPS))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(P.WORD), 0)


def tokenize_terms(c: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case word tokens without filler words; an empty list keeps every word."""
    stop = P.STOPWORDS if stopwords is None else stopwords
    found = words(c)
    if not stop:
        return found
    # isin on literals becomes one hash-set test per token.
    return F.filter(found, lambda w: ~w.isin(*stop))


def split_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(P.WORD))


def canonicalize_alias(c: Column, aliases: dict[str, str]) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), aliases.items(), F.lower(c))


def split_sentences(c: Column) -> Column:
    """Sentences in order; a bullet line is one sentence."""
    def of_line(line: Column) -> Column:
        return F.when(line.rlike(r"(?U)^[-*•]\s"), F.array(line)).otherwise(
            F.filter(F.transform(F.split(line, P.SENTENCE_END), strip), lambda s: s != ""))

    kept = F.filter(F.transform(lines(c), strip), lambda s: s != "")
    return F.flatten(F.transform(kept, of_line))


def is_bullet(s: Column) -> Column:
    return s.rlike(r"^[-*•] ")


def limit_sentences(c: Column, n: int = P.MAX_ANSWER_SENTENCES, items: int = P.MAX_LIST_ITEMS) -> Column:
    def limited(found: Column) -> Column:
        prose = F.array_join(F.slice(F.filter(found, lambda s: ~is_bullet(s)), 1, n), " ")
        bullets = F.array_join(F.slice(F.filter(found, is_bullet), 1, items), "\n")
        return F.array_join(F.filter(F.array(prose, bullets), lambda s: s != ""), "\n")

    return let(split_sentences(c), limited)


def extract_numbers(c: Column) -> Column:
    """Distinct numbers of a text, without group commas and trailing dots."""
    found = F.regexp_extract_all(c, F.lit(P.NUMBER), 0)
    return F.array_distinct(F.transform(found, lambda n: rep(rep(n, ","), r"\.+$")))


def truncate_words(c: Column, n: int = P.FAQ_TAIL_WORDS) -> Column:
    return let(F.split(strip(c), r"(?U)\s+"), lambda parts: F.when(
        F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit("..."))).otherwise(c))


def any_pattern(patterns: list[str], flags: str = "(?iUd)") -> str:
    """One alternation, so that a text is scanned by one compiled pattern."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def any_word_pattern(patterns: list[str], flags: str = "(?iUd)") -> str:
    r"""The same for patterns that all begin with ``\b`` and hold no choice outside brackets: the edge is tested once a place."""
    return flags + r"\b(?:" + "|".join(f"(?:{p.removeprefix(chr(92) + 'b')})" for p in patterns) + ")"


def alias_pattern(aliases: list[str]) -> str:
    """Whole-word alternation, longest alias first."""
    quoted = [_quote(a) for a in sorted(aliases, key=lambda a: (-len(a), a))]
    return r"(?iU)\b(" + "|".join(quoted) + r")\b"


def _quote(text: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in text)
