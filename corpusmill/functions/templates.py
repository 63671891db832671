"""Fixed texts that results must match word for word, and the one function that fills them from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fact field -> sentence.
FACT_SENTENCES = {
    "expense_ratio": "The expense ratio of {scheme_name} is {expense_ratio}.",
    "exit_load": "The exit load of {scheme_name} is: {exit_load}.",
    "min_investment": "For {scheme_name}, the minimum SIP is {min_sip}, the minimum first (lumpsum) investment is "
                      "{min_lumpsum}, and additional investments start at {min_additional}.",
    "lock_in": "{scheme_name} has {lock_in}.",
    "riskometer": "The riskometer rating of {scheme_name} is {riskometer}.",
    "benchmark": "The benchmark of {scheme_name} is the {benchmark}.",
    "nav": "The NAV of {scheme_name} was {nav} as of {nav_date}.",
    "aum": "The fund size (AUM) of {scheme_name} is {aum_cr}.",
    "category": "{scheme_name} is {article} {category} fund in the {sub_category} category ({plan_type} plan).",
    "launch_date": "{scheme_name} was launched on {launch_date}.",
    "objective": "Investment objective of {scheme_name}: {objective}",
    "tax": "Tax implication for {scheme_name}: {tax_implication}",
    "stamp_duty": "Stamp duty on investments in {scheme_name} is {stamp_duty}.",
    "registrar": "The registrar and transfer agent (RTA) for {scheme_name} is {registrar} ({registrar_website}), "
                 "which issues account statements.",
    "fund_managers": "{scheme_name} is managed by {managers}.",
    "top_holdings": "The top {n_top} holdings of {scheme_name} (as of {holdings_as_of}) are {top}.",
    "returns": "Annualised returns of {scheme_name} as published on {publisher}: {fund_returns}. "
               "Past performance does not indicate future returns.",
    "risk_ratios": "Risk ratios of {scheme_name} published by {publisher}: {ratios}.",
}

# Document section -> (title, text).
FACT_DOCUMENTS = {
    "overview": ("{scheme_name}: key facts",
                 "{scheme_name} is a {category} fund ({sub_category}) from {fund_house}, {plan_type} plan, "
                 "launched on {launch_date}.\n"
                 "Riskometer: {riskometer}. Benchmark: {benchmark}.\n"
                 "Expense ratio: {expense_ratio}. Exit load: {exit_load}. Stamp duty: {stamp_duty}.\n"
                 "Lock-in: {lock_in}.\n"
                 "Minimum SIP: {min_sip}. Minimum first (lumpsum) investment: {min_lumpsum}. "
                 "Minimum additional investment: {min_additional}.\n"
                 "NAV: {nav} as of {nav_date}. Fund size (AUM): {aum_cr} Cr.\n"
                 "Tax implication: {tax_implication}\n"
                 "Registrar & transfer agent (RTA): {registrar} ({registrar_website})."),
    "objective": ("{scheme_name}: investment objective", "Investment objective of {scheme_name}: {objective}"),
    "performance": ("{scheme_name}: returns and rankings",
                    "{scheme_name}: {basis} returns and category rank as shown on {publisher}.\n"
                    "{return_lines}{ratio_part}{analysis_part}"),
    "fund_managers": ("{scheme_name}: fund managers", "Fund managers of {scheme_name}:\n{manager_lines}"),
    "holdings": ("{scheme_name}: top holdings",
                 "Top {n_top} holdings of {scheme_name} (portfolio as of {holdings_as_of}, "
                 "{n_holdings} holdings in total):\n{holding_lines}"),
}

# The older document set: one per table cell, profile and FAQ.
OLD_OVERVIEW = ("Scheme Overview:\n{scheme_name}\n\nCategory: {category}\nSub-category: {sub_category}\n"
                "Risk Level: {riskometer}\n\nNAV: {nav} (as on {nav_date})\nRating: {rating}\n"
                "Minimum SIP Amount: {min_sip}\nFund Size: {aum_cr}")
OLD_HOLDINGS = ("Holdings of {scheme_name}:\n\n{rows}\n\nTotal Holdings Reported: {reported}\n"
                "Total Holdings Extracted: {extracted}")
OLD_RATIOS = ("Advanced Ratios:\n\nSharpe Ratio: {sharpe_ratio}\nSortino Ratio: {sortino_ratio}\nAlpha: {alpha}\n"
              "Beta: {beta}\nStandard Deviation: {standard_deviation}\nInformation Ratio: {information_ratio}\n"
              "Risk Rating: {rating} ({riskometer})")
OLD_RETURN_CELL = ("Returns Information:\n\nCategory: {category}\nReturn Type: {basis}\nPeriod: {period}\n"
                   "{metric}: {value}")
OLD_MANAGER = "Fund Manager:\n{name}\n\nTenure: {since}\nEducation: {education}\nExperience: {experience}"
OLD_FAQ = "Question:\n{question}\n\nAnswer:\n{answer}"


def fill(template: str, **columns: Column) -> Column:
    """Template with ``{name}`` parts taken from columns; a missing value reads ``None``."""
    pieces = re.split(r"(\{\w+\})", template)
    return F.concat(*[F.coalesce(columns[p[1:-1]].cast("string"), F.lit("None")) if p.startswith("{") else F.lit(p)
                      for p in pieces if p])


# Fixed replies: handler -> (text, kind of link).
FIXED_REPLIES = {
    "pii": ("For your privacy, please don't share personal details such as PAN, Aadhaar, phone numbers, email, account "
            "or folio numbers, or OTPs. I haven't processed or stored your message. Please ask your question again "
            "without them.", "help"),
    "refuse_advice": ("I can't give investment advice or recommendations. I can share facts such as a {house} scheme's "
                      "expense ratio, exit load, lock-in or published returns. This beginner's guide explains how to "
                      "evaluate mutual funds yourself.", "guide"),
    "refuse_comparison": ("I don't compare fund performance. I can share each scheme's published returns separately, "
                          "for example: \"What are the returns of the {example} fund?\"", "guide"),
    "off_topic": ("I can only help with factual questions about {house} schemes and {site}'s mutual fund features.",
                  "help"),
    "small_talk": ("Happy to help! I answer factual questions about {house} schemes on {site}, such as expense ratios, "
                   "exit loads, lock-in periods or how to download statements.", "list"),
    "ask_scheme": ("Please include the scheme name in your question, for example \"What is the lock-in of the {example} "
                   "fund?\". I cover {schemes}.", "list"),
    "not_found": ("I couldn't find this in my sources. {site}'s help centre may have more on it.", "help"),
}
SAFE_FALLBACK = ("I can only share factual information about {house} schemes, not recommendations or comparisons.",
                 "guide")
# The older answer texts over result rows.
OLD_NO_ROWS = "I could not find the requested information in the structured database. "
OLD_ONE_ROW = "The requested information for {name} is {value}. "
OLD_LIST = "Here is the requested information:\n"
OLD_NAV = "The latest NAV for {name} is {value} as of {extra}. "
OLD_PII_REPLY = ("For your privacy and security, I can’t process questions that include sensitive personal information.\n"
                 "Please remove any personal identifiers and ask your question again in a general form.\n\n"
                 "I answer only factual mutual fund queries related to {house} schemes using official {site} information:\n{link}")
