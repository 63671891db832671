"""Nested fact records: projection from page JSON, checks, sentences, documents and child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import templates as X
from corpusmill.functions.scalars import (compose_duration, embedded_json, format_currency, rupees, stable_id, trim_all,
                                          utc_to_local_date)
from corpusmill.functions.text import rep, strip

PAGE_SCHEMA = """
scheme_name string, fund_house string, category string, sub_category string, plan_type string, benchmark_name string,
launch_date string, expense_ratio string, exit_load string, stamp_duty string,
lock_in struct<years:int, months:int, days:int>, min_sip_investment bigint, min_investment_amount bigint,
mini_additional_investment bigint, nav double, nav_date string, aum double, category_info struct<tax_impact:string>,
description string, rta_details struct<rta_name:string, website:string>,
fund_manager_details array<struct<person_name:string, date_from:string, education:string, experience:string>>,
holdings array<struct<company_name:string, sector_name:string, instrument_name:string, corpus_per:double, portfolio_date:string>>,
return_stats array<struct<risk:string, sharpe_ratio:double, sortino_ratio:double, alpha:double, beta:double,
 standard_deviation:double, information_ratio:double>>,
analysis array<struct<analysis_type:string, analysis_desc:string>>,
stats array<struct<type:string, stat_1y:double, stat_3y:double, stat_5y:double>>
"""


def truthy(c: Column) -> Column:
    """NULL for the values the source treats as absent: empty text and a zero."""
    return F.when(~c.cast("string").isin("", "0", "0.0"), c)


def project_facts(df: DataFrame, html: Column, root: str = "props.pageProps.data") -> DataFrame:
    """Typed facts from the JSON a page carries, one flat record with nested children."""
    keep = df.columns
    page = F.from_json(F.get_json_object(embedded_json(html), f"$.{root}"), PAGE_SCHEMA)
    read = df.withColumn("_p", page)
    read = read.withColumn("_p", trim_all(F.col("_p"), read.schema["_p"].dataType))
    p = F.col("_p")
    stats = F.try_element_at(p["return_stats"], F.lit(1))
    fund_return = F.try_element_at(F.filter(p["stats"], lambda s: s["type"] == "FUND_RETURN"), F.lit(1))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return read.select(
        *keep, p["scheme_name"].alias("scheme_name"), p["fund_house"].alias("fund_house"),
        p["category"].alias("category"), p["sub_category"].alias("sub_category"), p["plan_type"].alias("plan_type"),
        F.concat(truthy(stats["risk"]), F.lit(" Risk")).alias("riskometer"), p["benchmark_name"].alias("benchmark"),
        p["launch_date"].alias("launch_date"), F.concat(truthy(p["expense_ratio"]), F.lit("%")).alias("expense_ratio"),
        p["exit_load"].alias("exit_load"), p["stamp_duty"].alias("stamp_duty"),
        compose_duration(p["lock_in"]["years"], p["lock_in"]["months"], p["lock_in"]["days"]).alias("lock_in"),
        p["min_sip_investment"].alias("min_sip"), p["min_investment_amount"].alias("min_lumpsum"),
        p["mini_additional_investment"].alias("min_additional"), p["nav"].alias("nav"),
        p["nav_date"].alias("nav_date"), F.round(truthy(p["aum"]), 2).alias("aum_cr"),
        p["category_info"]["tax_impact"].alias("tax_implication"), p["description"].alias("objective"),
        p["rta_details"]["rta_name"].alias("registrar"), p["rta_details"]["website"].alias("registrar_website"),
        none(F.transform(p["fund_manager_details"], lambda m: F.struct(
            m["person_name"].alias("name"), utc_to_local_date(m["date_from"]).alias("since"),
            m["education"].alias("education"), m["experience"].alias("experience"))),
            "array<struct<name:string,since:string,education:string,experience:string>>").alias("fund_managers"),
        none(F.transform(p["holdings"], lambda h: F.struct(
            h["company_name"].alias("name"), h["sector_name"].alias("sector"), h["instrument_name"].alias("instrument"),
            F.round(h["corpus_per"], 2).alias("weight_pct"))),
            "array<struct<name:string,sector:string,instrument:string,weight_pct:double>>").alias("holdings"),
        utc_to_local_date(F.try_element_at(p["holdings"], F.lit(1))["portfolio_date"]).alias("holdings_as_of"),
        F.struct(*[stats[r].alias(r) for r in P.RATIO_FIELDS]).alias("risk_ratios"),
        none(F.transform(p["analysis"], lambda a: F.struct(
            a["analysis_type"].alias("kind"), a["analysis_desc"].alias("text"))),
            "array<struct<kind:string,text:string>>").alias("analysis"),
        F.struct(*[fund_return[f"stat_{y}"].alias(y) for y in ("1y", "3y", "5y")]).alias("json_fund_returns"))


def missing(fields: list[str], children: dict[str, str] | None = None) -> Column:
    """Problems of a row as an array: one for each value that is null or empty, one for each empty child list."""
    found = [F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f"missing {f}")) for f in fields]
    found += [F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit(text)) for c, text in (children or {}).items()]
    return F.array_compact(F.array(*found))


def required_fields(df: DataFrame, key: str, fields: list[str], children: dict[str, str] | None = None) -> DataFrame:
    """One problem row per missing required value and per empty child list."""
    return df.select(key, F.explode(missing(fields, children)).alias("problem"))


def tolerance_check(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str,
                    tolerance: float = P.RETURNS_TOLERANCE) -> DataFrame:
    """Keys where two sources both know a value and disagree by more than the tolerance."""
    return left.join(right, on).where(F.abs(F.col(a) - F.col(b)) > tolerance).select(*on, a, b)


# ---- sentences and documents ----

def py_number(c: Column) -> Column:
    return c.cast("string")


def by_weight(holdings: Column, n: int, missing_as_zero: bool) -> Column:
    """Heaviest holdings first, names breaking ties; a missing weight sorts last, or as zero."""
    w = F.coalesce if missing_as_zero else (lambda x, _: x)

    def before(a: Column, b: Column) -> Column:
        x, y = w(a["weight_pct"], F.lit(0.0)), w(b["weight_pct"], F.lit(0.0))
        return (F.when(x.isNull() & y.isNotNull(), 1).when(y.isNull() & x.isNotNull(), -1)
                .when(x > y, -1).when(x < y, 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1)
                .otherwise(0))

    return F.slice(F.array_sort(holdings, before), 1, n)


def ratio_list(ratios: Column) -> Column:
    parts = [F.concat(F.lit(r.replace("_", " ") + " "), py_number(ratios[r])) for r in P.RATIO_FIELDS]
    return F.array_join(F.array_compact(F.array(*parts)), ", ")


def return_list(returns: Column, metric: str) -> Column:
    kept = F.filter(returns, lambda r: (r["metric"] == metric) & r["value"].isNotNull())
    return F.array_join(F.transform(kept, lambda r: F.concat_ws(" ", r["period"], r["value"])), ", ")


def fact_sentence(field: Column, publisher: str = "the source page") -> Column:
    """Sentence for one fact field of the record in this row; NULL for an unknown field.

    A CASE over the field name, so only the asked sentence is built.
    """
    c = {name: F.col(name) for name in (
        "scheme_name expense_ratio riskometer benchmark nav_date category sub_category plan_type launch_date objective "
        "tax_implication stamp_duty registrar registrar_website holdings_as_of").split()}
    managers = F.array_sort(F.transform(F.col("fund_managers"), lambda m: F.struct(m["since"], m["name"])))
    top = by_weight(F.col("holdings"), P.TOP_HOLDINGS_ANSWER, False)
    c |= {
        "exit_load": rep(F.col("exit_load"), r"\.+$"),
        "min_sip": format_currency(F.col("min_sip")), "min_lumpsum": format_currency(F.col("min_lumpsum")),
        "min_additional": format_currency(F.col("min_additional")),
        "lock_in": F.coalesce(F.concat(F.lit("a lock-in period of "), F.nullif(F.col("lock_in"), F.lit(""))),
                              F.lit("no lock-in period")),
        "nav": format_currency(F.col("nav"), 2), "aum_cr": format_currency(F.col("aum_cr"), 2, " Cr"),
        "article": F.when(F.lower(F.left("category", F.lit(1))).isin(*"aeiou"), "an").otherwise("a"),
        "managers": F.array_join(F.transform(managers, lambda m: F.concat(
            m["name"], F.lit(" (since "), m["since"], F.lit(")"))), ", "),
        "n_top": F.size(top),
        "top": F.array_join(F.transform(top, lambda h: F.concat(
            h["name"], F.lit(" ("), F.coalesce(py_number(h["weight_pct"]), F.lit("None")), F.lit("%)"))), ", "),
        "publisher": F.lit(publisher), "fund_returns": return_list(F.col("returns"), "Fund returns"),
        "ratios": ratio_list(F.col("risk_ratios")),
    }
    out = None
    for name, template in X.FACT_SENTENCES.items():
        sentence = X.fill(template, **c)
        out = F.when(field == name, sentence) if out is None else out.when(field == name, sentence)
    return out


def fields_cross(requests: DataFrame, facts: DataFrame, publisher: str = "the source page") -> DataFrame:
    """Every requested (scheme, field) pair as one answer row; unknown schemes and fields fall out.

    ``requests``: qid, scheme_ids, fact_fields. Each asked sentence is built once, however many requests ask for it, and
    only text is joined to the requests.
    """
    known = F.array(*[F.lit(f) for f in X.FACT_SENTENCES])
    asked = requests.select("qid", F.posexplode("scheme_ids").alias("scheme_pos", "scheme_id"), "fact_fields")
    pairs = asked.select("qid", "scheme_pos", "scheme_id", F.posexplode(F.filter(
        "fact_fields", lambda f: F.array_contains(known, f))).alias("field_pos", "field"))
    said = pairs.select("scheme_id", "field").distinct().join(facts, "scheme_id").select(
        "scheme_id", "field", "scheme_name", fact_sentence(F.col("field"), publisher).alias("sentence"), "source_url",
        F.left("scraped_at", F.lit(10)).alias("scraped_at"))
    return pairs.join(said, ["scheme_id", "field"]).select(
        "qid", "scheme_pos", "field_pos", "scheme_id", "scheme_name", "field", "sentence", "source_url", "scraped_at")


def every_cross(lists: DataFrame, facts: DataFrame, n: int, publisher: str = "the source page") -> DataFrame:
    """Rows as of ``fields_cross`` for lists of fields asked of every scheme: the first n schemes of each field.

    ``lists``: qid, fact_fields. The first n pairs of a list, by scheme and field, are always among them. ``scraped_at`` is
    the newest of all schemes, shown or not.
    """
    known = F.array(*[F.lit(f) for f in X.FACT_SENTENCES])
    # Only sentences that some list asks for are built; there are as many names as templates at most.
    asked = lists.select(F.explode(F.filter("fact_fields", lambda f: F.array_contains(known, f))).alias("f")).distinct().collect()
    first = None
    for name in sorted(r.f for r in asked) or [None]:
        # Each task keeps n rows of a field and sorts no more; a literal field builds its own sentence only.
        field = F.lit(name).cast("string")
        one = facts.select("scheme_id", field.alias("field"), "scheme_name", fact_sentence(field, publisher).alias("sentence"), "source_url").where(
            "sentence IS NOT NULL").orderBy("scheme_id").limit(n)
        first = one if first is None else first.unionByName(one)
    newest = facts.agg(F.max(F.left("scraped_at", F.lit(10)))).scalar()
    wanted = lists.select("qid", F.posexplode("fact_fields").alias("field_pos", "field"))
    order = W.partitionBy("qid").orderBy("scheme_id")
    return wanted.join(first, "field").select(
        "qid", (F.dense_rank().over(order) - 1).alias("scheme_pos"), "field_pos", "scheme_id", "scheme_name", "field", "sentence",
        "source_url", newest.alias("scraped_at"))


def facts_to_documents(facts: DataFrame, publisher: str = "the source page") -> DataFrame:
    """Five templated documents per fact record, with stable ids and provenance."""
    c = {name: F.col(name) for name in (
        "scheme_name category sub_category fund_house plan_type launch_date riskometer benchmark expense_ratio exit_load "
        "stamp_duty nav_date tax_implication registrar registrar_website objective holdings_as_of basis").split()}
    kind = {f.name: f.dataType for f in facts.schema.fields}
    rows = F.col("returns")
    metrics = F.array_distinct(F.transform(rows, lambda r: r["metric"]))
    ratios = ratio_list(F.col("risk_ratios"))
    analysis = F.array_join(F.transform("analysis", lambda a: F.concat(
        F.lit("- "), F.when(a["kind"] == "PROS", "Pro").otherwise("Con"), F.lit(": "), a["text"])), "\n")
    top = by_weight(F.col("holdings"), P.TOP_HOLDINGS_DOCUMENT, True)
    c |= {
        "lock_in": F.coalesce(F.nullif(F.col("lock_in"), F.lit("")), F.lit("no lock-in period")),
        **{n: rupees(F.col(n), kind[n]) for n in ("min_sip", "min_lumpsum", "min_additional", "nav", "aum_cr")},
        "publisher": F.lit(publisher),
        "return_lines": F.array_join(F.transform(metrics, lambda m: F.concat(m, F.lit(": "), F.array_join(F.transform(
            F.filter(rows, lambda r: (r["metric"] == m) & (r["value"] != "")),
            lambda r: F.concat_ws(" ", r["period"], r["value"])), ", "))), "\n"),
        "ratio_part": F.when(ratios != "", F.concat(F.lit("\nRisk ratios: "), ratios, F.lit("."))).otherwise(""),
        "analysis_part": F.when(analysis != "", F.concat(F.lit("\nAnalysis:\n"), analysis)).otherwise(""),
        "manager_lines": F.array_join(F.transform("fund_managers", lambda m: X.fill(
            "- {name} (managing since {since}). Education: {education} Experience: {experience}",
            **{f: m[f] for f in ("name", "since", "education", "experience")})), "\n"),
        "n_top": F.size(top), "n_holdings": F.size("holdings"),
        "holding_lines": F.array_join(F.transform(top, lambda h: X.fill(
            "- {name} ({sector}, {instrument}): {weight_pct}%",
            **{f: h[f] for f in ("name", "sector", "instrument", "weight_pct")})), "\n"),
    }
    docs = F.array(*[F.struct(F.lit(section).alias("section"), X.fill(title, **c).alias("title"),
                              strip(X.fill(text, **c)).alias("page_content"))
                     for section, (title, text) in X.FACT_DOCUMENTS.items()])
    flat = facts.select("scheme_id", "scheme_name", "source_url", F.left("scraped_at", F.lit(10)).alias("scraped_at"),
                        F.explode(docs).alias("d"))
    return flat.select(
        stable_id(F.col("source_url"), F.col("d.section"), F.col("d.title"), F.lit(0)).alias("id"),
        F.col("d.page_content").alias("page_content"), F.lit("scheme_fact").alias("doc_type"),
        F.col("d.section").alias("section"), F.col("d.title").alias("title"), "scheme_id", "scheme_name",
        "source_url", "scraped_at")


def table_row_documents(facts: DataFrame) -> DataFrame:
    """Overview, ratios and full holdings, one document per return cell, per manager and per FAQ."""
    cols = {n: F.col(n) for n in ("scheme_name category sub_category riskometer nav nav_date rating min_sip aum_cr "
                                  "basis").split()}
    ratios = {r: F.col("risk_ratios")[r] for r in P.RATIO_FIELDS}
    holding_rows = F.array_join(F.transform("holdings", lambda h: X.fill(
        "{name} | {sector} | {instrument} | {weight_pct}%",
        **{f: h[f] for f in ("name", "sector", "instrument", "weight_pct")})), "\n")

    def made(section: str, kind: str, text: Column, part: Column, detail: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(kind).alias("content_type"), part.cast("int").alias("part"),
                        detail.cast("string").alias("detail"), strip(text).alias("text"))

    none = F.lit(None).cast("string")
    single = F.array(
        made("overview", "summary", X.fill(X.OLD_OVERVIEW, **cols), F.lit(0), none),
        made("holdings", "table", X.fill(X.OLD_HOLDINGS, scheme_name=cols["scheme_name"], rows=holding_rows,
                                         reported=F.col("reported_holdings"), extracted=F.size("holdings")),
             F.lit(0), F.size("holdings")),
        made("advanced_ratios", "numeric", X.fill(X.OLD_RATIOS, **ratios, rating=cols["rating"],
                                                  riskometer=cols["riskometer"]), F.lit(0), none))
    cells = F.transform("returns", lambda r, i: made("returns_and_rankings", "table_row", X.fill(
        X.OLD_RETURN_CELL, category=cols["category"], basis=cols["basis"], period=r["period"], metric=r["metric"],
        value=r["value"]), i, r["period"]))
    profiles = F.transform("fund_managers", lambda m, i: made("fund_management", "profile", X.fill(
        X.OLD_MANAGER, **{f: m[f] for f in ("name", "since", "education", "experience")}), i, m["name"]))
    faqs = F.transform("faqs", lambda q, i: made("faqs", "qa", X.fill(
        X.OLD_FAQ, question=q["question"], answer=q["answer"]), i, q["question"]))
    return facts.select("scheme_id", "scheme_name", "source_url",
                        F.explode(F.concat(single, cells, profiles, faqs)).alias("d")).select(
        "scheme_id", "scheme_name", "source_url", "d.*")


def json_documents(df: DataFrame, key: str, overview: list[str], objective: Column, faqs: Column,
                   last_updated: Column) -> DataFrame:
    """A nested record as pretty JSON text, an objective text and one document per FAQ, sharing their metadata."""
    pretty = rep(F.to_json(F.struct(*overview), {"pretty": "true", "ignoreNullFields": "false"}),
                 r'(?m)^(\s*"(?:[^"\\]|\\.)*") : ', "$1: ")
    docs = F.concat(
        F.array(F.struct(F.lit("overview").alias("section"), pretty.alias("text"))),
        F.array(F.struct(F.lit("investment_objective").alias("section"), objective.alias("text"))),
        F.transform(faqs, lambda q: F.struct(F.lit("faq").alias("section"), F.concat(
            F.lit("Question: "), q["question"], F.lit("\n\nAnswer: "), q["answer"]).alias("text"))))
    return df.select(key, last_updated.alias("last_updated"), F.posexplode(docs).alias("part", "d")).select(
        key, "part", "d.section", "d.text", "last_updated")


# ---- child tables ----

SCHEME_COLUMNS = (
    "scheme_id scheme_name fund_house category sub_category plan_type riskometer benchmark launch_date expense_ratio "
    "exit_load stamp_duty lock_in min_sip min_lumpsum min_additional nav nav_date aum_cr tax_implication objective "
    "registrar registrar_website holdings_as_of source_url scraped_at").split()


def explode_children(df: DataFrame, key: str, child: str) -> DataFrame:
    """Child rows of a nested array carrying the parent's key, with their order."""
    return df.select(key, F.posexplode(child).alias("ord", "c")).select(key, "ord", "c.*")


def fact_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The six relational tables of a nested fact collection."""
    return {
        "schemes": facts.select(*SCHEME_COLUMNS),
        "fund_managers": explode_children(facts, "scheme_id", "fund_managers"),
        "holdings": explode_children(facts, "scheme_id", "holdings"),
        "returns": facts.select("scheme_id", "basis", F.posexplode("returns").alias("ord", "c")).select(
            "scheme_id", "basis", "ord", "c.*"),
        "risk_ratios": facts.select("scheme_id", "risk_ratios.*"),
        "analysis": explode_children(facts, "scheme_id", "analysis"),
    }
