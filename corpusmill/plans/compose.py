"""Inputs composed from the given tables, as SQL text both engines read the same way, and SQL forms of common steps."""

from __future__ import annotations

from corpusmill.functions import patterns as P

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re_edges(pattern: str) -> str:
    r"""A pattern with ``\b`` at its ends as one without look-arounds; equal for existence tests."""
    pattern = pattern.replace(r"\b.*\b", r"[^\p{L}\p{N}_\n](?:[^\n]*[^\p{L}\p{N}_\n])?")
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|{NW})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?:$|{NW})"
    return pattern.replace(r"\w", W)


def re_any(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{re_edges(p)})" for p in patterns)


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def sql_tokens(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'))"


STOP_LIST = "[" + ", ".join(lit(w) for w in P.STOPWORDS) + "]"


def sql_terms(x: str) -> str:
    return f"list_filter({sql_words(x)}, lambda w: NOT list_contains({STOP_LIST}, w))"


def chain(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, {lit(pattern)}, {to if to.startswith('chr') or '||' in to else lit(to)}, 'g')"
    return x


def sql_strip_urls(x: str) -> str:
    return chain(x, (r"\[([^\]]+)\]\(https?://[^\)]+\)", r"\1"), (r"!\[([^\]]*)\]\(https?://[^\)]+\)", r"\1"),
                 (r"https?://[^\s\)]+", ""), ("  +", " "), ("\n\n\n+", "\n\n"))


def sql_clean_text(x: str) -> str:
    x = chain(sql_strip_urls(x), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
              (r"(?m)^![^\n]*$", ""), (r"(?m)^\d+ min read$", ""), (r"(?m)^(Loading\.\.\.|```)\s*$", ""),
              ("[ \t]*\n[ \t]*", "\n"), ("\n{3,}", "\n\n"))
    return sql_strip(x)


MARK, DOT = "chr(1)", "chr(2)"


def sql_sentences(x: str) -> str:
    """Sentences of one text, look-behinds replaced by marks set beforehand."""
    line = chain("l", (rf"(^|{NW})(Rs|No)\.(\s)", r"'\1\2' || chr(2) || '\3'"))
    for _ in range(2):
        line = chain(line, (r"([\s:]\d\d?)\.(\s)", r"'\1' || chr(2) || '\2'"))
    line = chain(line, (r"""([.!?])\s+([A-Z0-9₹"'(])""", r"'\1' || chr(1) || '\2'"))
    parts = f"list_transform(string_split(replace({line}, chr(2), '.'), chr(1)), lambda s: {sql_strip('s')})"
    # a protected dot is a dot again before the split, so a capital after it stays in the sentence
    kept = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {sql_strip('l')}), lambda l: l <> '')"
    return (f"flatten(list_transform({kept}, lambda l: CASE WHEN regexp_matches(l, '^[-*•]\\s') THEN [l] "
            f"ELSE list_filter({parts}, lambda s: s <> '') END))")


def sql_limit(x: str, n: int = P.MAX_ANSWER_SENTENCES, items: int = P.MAX_LIST_ITEMS) -> str:
    bullet = "regexp_matches(s, '^[-*•] ')"
    prose = f"array_to_string(list_filter({x}, lambda s: NOT {bullet})[1:{n}], ' ')"
    bullets = f"array_to_string(list_filter({x}, lambda s: {bullet})[1:{items}], chr(10))"
    return f"array_to_string(list_filter([{prose}, {bullets}], lambda s: s <> ''), chr(10))"


def sql_strip_links(x: str) -> str:
    return sql_strip(chain(
        x, (r"https?://[^\s)\]]+[^\s)\].,;:!?]|www\.[^\s)\]]+[^\s)\].,;:!?]", ""),
        (r"\(\s*(?:see|at|via|link)?\s*\)", ""), (r"[ \t]{2,}", " "), (r"[ \t]+([.,;:!?])", r"\1")))


def sql_advice(x: str) -> str:
    return f"regexp_matches({x}, {lit(re_any(P.ADVICE_OUT))})"


# Personal data in SQL: consumed edges instead of look-arounds.
_L, _R = r"(^|[^\d₹.,])", r"($|[^\d.,%])"
SQL_PII = {
    "PAN": rf"(?i)(^|{NW})[A-Z]{{5}}[0-9]{{4}}[A-Z]($|{NW})",
    "Aadhaar": rf"{_L}[2-9]\d{{3}}[\s-]?\d{{4}}[\s-]?\d{{4}}{_R}",
    "phone number": rf"{_L}(?:\+?91[\s-]?|0)?[6-9]\d{{4}}[\s-]?\d{{5}}{_R}",
    "email": rf"(^|{NW}){W}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]*{W}($|{NW})",
    "UPI ID": rf"(?i)(^|{NW}){W}[\p{{L}}\p{{N}}_.-]+@(?:ok)?[a-z]{{2,}}($|[^\p{{L}}\p{{N}}_.])",
    "OTP / PIN / password":
        rf"(?i)(^|{NW})(?:otp|m?pin|cvv|password|passcode)"
        r"(?:\s+(?:is|was)\s*[A-Za-z0-9@#$!]*\d|\s*[:=-]\s*[A-Za-z0-9@#$!]*\d|\s*[@#$!][A-Za-z0-9@#$!]*\d"
        r"|\s+[A-Za-z0-9@#$!]*\d)",
    "account or folio number":
        rf"(?i)(^|{NW})(?:a/?c|acc(?:ount)?|acct|folio|client\s*id|customer\s*id|demat)"
        r"(?:(?:\s*[#:]|\s+(?:no\.?|number))\s*[:#-]?\s*|\s*[:#-]\s*|\s+)\d[\d/\s-]{5,}\d",
    "long number (account/ID)": rf"{_L}\d{{11,18}}{_R}",
}


def sql_luhn(digits: str) -> str:
    """Checksum of a digit string as a list sum."""
    n = f"len({digits})"
    digit = f"CAST(substr({digits}, i, 1) AS INTEGER)"
    value = (f"CASE WHEN ({n} - i) % 2 = 1 THEN CASE WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END "
             f"ELSE {digit} END")
    return f"list_sum(list_transform(range(1, {n} + 1), lambda i: {value})) % 10 = 0"


def sql_has_card(x: str) -> str:
    # Every non-digit is doubled, so that the edge of one run can end it and begin the next.
    doubled = rf"regexp_replace({x}, '([^\d])', '\1\1', 'g')"
    runs = rf"regexp_extract_all({doubled}, '(?:^|[^\d])((?:\d(?:[\s-][\s-])?){{12,18}}\d)(?:[^\d]|$)', 1)"
    digits = rf"list_transform({runs}, lambda r: regexp_replace(r, '\D', '', 'g'))"
    return (f"len(list_filter({digits}, lambda d: len(d) BETWEEN 13 AND 19 AND {sql_luhn('d')})) > 0")


def sql_pii(x: str) -> str:
    flags = [f"CASE WHEN regexp_matches({x}, {lit(p)}) THEN {lit(k)} END" for k, p in SQL_PII.items()]
    flags.append(f"CASE WHEN {sql_has_card(x)} THEN {lit(P.CARD_KIND)} END")
    return f"list_filter([{', '.join(flags)}], lambda k: k IS NOT NULL)"


def sql_refusal(x: str) -> str:
    advice = [p.replace("{house}", "(acme )?") for p in P.ADVICE_IN]
    return (f"CASE WHEN regexp_matches({x}, {lit(re_any(P.COMPARISON_IN))}) THEN 'refuse_comparison' "
            f"WHEN regexp_matches({x}, {lit(re_any(advice))}) THEN 'refuse_advice' END")


# ---- composed inputs (portable SQL expressions) ----

ID4 = "lpad(cast(conv_id % 10000 as string), 4, '0')"
# A message per conversation turn: the turn's own text and, by turn and conversation, something a screen must see or not.
MESSAGE = f"""text || CASE (conv_id * 5 + turn) % 20
 WHEN 0 THEN ' My PAN is ABCDE' || {ID4} || 'F, show my holdings'
 WHEN 1 THEN ' aadhaar 2345 6789 ' || {ID4} || ' linked'
 WHEN 2 THEN ' call me on 98765' || lpad(cast(conv_id % 100000 as string), 5, '0')
 WHEN 3 THEN ' mail me at user' || cast(conv_id as string) || '@mail.example'
 WHEN 4 THEN ' pay to user' || cast(conv_id as string) || '@okbank'
 WHEN 5 THEN ' my OTP is 48' || {ID4}
 WHEN 6 THEN ' folio no 1234567/' || {ID4} || ' balance'
 WHEN 7 THEN ' card 4111 1111 1111 ' || {ID4} || ' declined'
 WHEN 8 THEN ' my id 12345678901' || {ID4}
 WHEN 9 THEN ' Should I invest in fund ' || cast(conv_id as string) || '?'
 WHEN 10 THEN ' Compare the 5 year returns of A and B'
 WHEN 11 THEN ' best acme fund for tax saving'
 WHEN 12 THEN ' Has the fund beaten its benchmark?'
 WHEN 13 THEN ' What is the minimum SIP of ₹1,000? Also what is a folio number?'
 WHEN 14 THEN ' I have not received the OTP even after trying; AUM is ₹1,47,404.50 Cr'
 WHEN 15 THEN ' which fund gave the highest returns last year?'
 WHEN 16 THEN ' NAV is 1576.03, expense ratio 0.65% vs 0.69%'
 ELSE '' END"""

# An answer per conversation turn, some with links, numbers and advice.
ANSWER = """text || CASE (conv_id * 3 + turn) % 7
 WHEN 0 THEN ' First fact is 0.65%. Second fact (see https://example.com/x). Third fact. Fourth fact.'
 WHEN 1 THEN ' You should buy this fund now.'
 WHEN 2 THEN chr(10) || '- Fund A: 0.69%' || chr(10) || '- Fund B: 0.65%'
 WHEN 3 THEN ' Limit is Rs. 1 lakh. No. Of units varies. Here: 1. Select Reports. 2. Choose ' || cast(conv_id as string) || '. Done.'
 WHEN 4 THEN ' It has outperformed its benchmark.'
 WHEN 5 THEN ' See www.example.com/a , then wait .'
 ELSE '' END"""
# The same without the document text in front, so that short answers reach the sentence limit too.
SHORT_ANSWER = "'Turn ' || cast(turn as string) || ' of ' || cast(conv_id as string) || '. ' || " + ANSWER.replace(
    "text || ", "")

# Markdown of a help page or post per document.
MARKDOWN = """'lead of ' || lang || chr(10) || '# Customer Support' || chr(10) || '# Guide ' || cast(doc_id as string)
 || chr(10) || text || chr(10) || '## Returns and rankings' || chr(10) || 'Category: ' || source || ' ' || chr(10)
 || 'Annualised returns' || chr(10) || 'Absolute returns' || chr(10)
 || ' | 1Y | 3Y |  | All' || chr(10) || '---|---|---|---|---' || chr(10)
 || 'Fund returns | +' || cast(n_chars % 50 as string) || '.5% | -- | x | +7.7%' || chr(10)
 || 'Rank | ' || cast(doc_id % 9 as string) || ' |  | y | --' || chr(10)
 || '### Minimum amounts' || chr(10) || 'Min. first | ₹' || cast(n_chars as string) || chr(10) || '---|---' || chr(10)
 || 'Min. SIP | ₹1,000' || chr(10) || 'Rating' || chr(10) || chr(10) || cast(doc_id % 5 as string) || chr(10)
 || '## Holdings (' || cast(doc_id % 4 as string) || ')' || chr(10) || 'Name | Sector | Instrument | Assets' || chr(10)
 || '---|---|---|---' || chr(10) || 'Co A | ' || lang || ' | Equity | 7.5%' || chr(10) || 'broken | row' || chr(10)
 || 'Co B | ' || source || ' | Debt | ' || cast(n_chars % 10 as string) || '%' || chr(10) || chr(10) || 'Co C | x | y | z' || chr(10)
 || '## Fund management' || chr(10) || '### ' || chr(10) || 'Raj ' || source || chr(10) || 'Oct 2023 - Present' || chr(10)
 || 'View details' || chr(10) || 'Education' || chr(10) || 'MBA ' || lang || chr(10) || 'CFA' || chr(10)
 || 'Experience' || chr(10) || 'Prior to this ' || source || chr(10) || 'Also manages these schemes' || chr(10) || 'Other' || chr(10)
 || '### Ann ' || lang || chr(10) || 'Jan 2020 - Present' || chr(10) || 'Education' || chr(10) || 'BCom' || chr(10)
 || '## FAQs' || chr(10) || '### What is ' || lang || '?' || chr(10) || 'It is   ' || chr(10) || '  ' || source || '.' || chr(10)
 || '!Looking to invest' || chr(10) || 'promo' || chr(10) || '### Empty?' || chr(10) || '### How long is it?' || chr(10)
 || text || chr(10) || '## About' || chr(10) || 'tail' || chr(10) || '### Not a question?' || chr(10) || 'after the end'"""

# A raw help article and a blog post per document.
HELP_PAGE = """CASE WHEN doc_id % 11 = 0 THEN '# Customer Support' || chr(10) || text
 WHEN doc_id % 11 = 1 THEN '# Customer Support' || chr(10) || '# Q' || chr(10) || 'Some Error Occured'
 WHEN doc_id % 11 = 2 THEN '# Customer Support' || chr(10) || '# How to redeem ' || source || chr(10) || text
 WHEN doc_id % 11 = 3 THEN '# Customer Support' || chr(10) || '# Blank ' || source || chr(10) || 'Was the answer helpful?'
 ELSE '# Customer Support' || chr(10) || '# How to redeem ' || source || '? ' || chr(10) || '![i](/a.png)' || chr(10)
 || text || chr(10) || '[here](https://example.com/h) ' || chr(10) || 'Was the answer helpful?' || chr(10) || 'Yes' END"""
BLOG_PAGE = """'nav' || chr(10) || '# What are **' || source || '** funds' || chr(10) || '5 min read' || chr(10) || text || chr(10)
 || '## Types of ' || lang || chr(10) || 'body one' || chr(10) || '### Deep ' || source || chr(10) || text || chr(10)
 || '## FAQs' || chr(10) || '### Is **' || lang || '** safe?' || chr(10) || 'Yes.' || chr(10) || '### Blank?' || chr(10)
 || CASE doc_id % 3 WHEN 0 THEN '## Disclaimer' WHEN 1 THEN 'Do you like this edition?' ELSE 'Recent Posts' END || chr(10)
 || 'after the article' || chr(10) || '# Other'"""
