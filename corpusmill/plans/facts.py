"""Fact records: projection, checks, sentences, documents, child tables and the publishing gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import templates as X
from corpusmill.operators import facts as O
from corpusmill.operators import payloads, publish
from corpusmill.operators.snapshots import Checked, Snapshots
from corpusmill.plans import compose as C
from corpusmill.plans.registry import Tables, query
from corpusmill.session import materialize, scratch_path

# Scalar facts of a part, portable.
SCALARS = {
    "scheme_id": "'part-' || cast(p_partkey as string)",
    "scheme_name": "p_name || ' ' || cast(p_partkey as string)",
    "fund_house": "'House ' || p_brand",
    "category": "p_type",
    "sub_category": "p_brand",
    "plan_type": "'Direct'",
    "riskometer": "CASE p_size % 3 WHEN 0 THEN 'Low Risk' WHEN 1 THEN 'High Risk' ELSE 'Very High Risk' END",
    "benchmark": "p_type || ' Index'",
    "launch_date": "'20' || lpad(cast(p_size % 25 as string), 2, '0') || '-01-05'",
    "expense_ratio": "'0.' || lpad(cast(p_size as string), 2, '0') || '%'",
    "exit_load": "'Nil after ' || cast(p_size as string) || ' days.'",
    "stamp_duty": "'0.005%'",
    "lock_in": "CASE WHEN p_size % 5 = 0 THEN cast(p_size as string) || ' years' END",
    "min_sip": "cast(p_size * 100 as bigint)",
    "min_lumpsum": "cast(p_size * 1000 as bigint)",
    "min_additional": "cast(p_size * 50 as bigint)",
    "nav": "p_retailprice",
    "nav_date": "'2024-02-0' || cast(1 + p_size % 9 as string)",
    "aum_cr": "round(p_retailprice * 10 + 0.25, 2)",
    "tax_implication": "'Taxed as ' || p_type",
    "objective": "'Grow ' || p_name || '.'",
    "registrar": "'RTA ' || p_brand",
    "registrar_website": "'rta.example'",
    "holdings_as_of": "'2024-01-31'",
    "source_url": "'https://example.com/part/' || cast(p_partkey as string)",
    "scraped_at": "'2024-03-0' || cast(1 + p_partkey % 9 as string) || 'T10:00:00'",
    "basis": "'annualised'",
    "rating": "cast(p_size % 5 as string)",
    "reported_holdings": "p_size",
}
SINCE = "'20' || cast(10 + (p_partkey + m * 7) % 15 as string) || '-01-01'"
WEIGHT = "CASE WHEN (p_partkey + h) % 6 <> 0 THEN ((p_partkey * 7 + h * 13) % 1000) / 10.0D END"
RETURNS = [("Fund returns", "1Y", "'+' || cast(p_size as string) || '.5%'"), ("Fund returns", "3Y", "CASE WHEN p_size % 2 = 0 THEN '7%' END"),
           ("Rank", "1Y", "cast(p_partkey % 9 as string)"), ("Rank", "3Y", "cast(NULL as string)")]
RATIOS = {"sharpe_ratio": "p_size / 10.0D", "sortino_ratio": "cast(NULL as double)", "alpha": "CASE WHEN p_size % 2 = 0 THEN p_size / 4.0D END",
          "beta": "cast(1.5 as double)", "standard_deviation": "p_size + 0.5D", "information_ratio": "cast(NULL as double)"}


def facts_from_part(t: Tables):
    children = [
        "transform(sequence(1, cast(p_partkey % 3 + 1 as int)), m -> named_struct('name', 'M' || cast(m as string) || ' ' || p_brand, "
        f"'since', {SINCE}, 'education', 'MBA.', 'experience', 'Years ' || cast(p_size as string) || '.')) AS fund_managers",
        "transform(sequence(1, p_size % 15 + 1), h -> named_struct('name', 'H' || cast(h as string), 'sector', p_type, "
        f"'instrument', 'EQ', 'weight_pct', {WEIGHT})) AS holdings",
        "array(" + ", ".join(f"named_struct('metric', '{m}', 'period', '{p}', 'value', {v})" for m, p, v in RETURNS) + ") AS returns",
        "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in RATIOS.items()) + ") AS risk_ratios",
        "filter(array(named_struct('kind', 'PROS', 'text', 'Cheap ' || p_name), CASE WHEN p_size % 2 = 1 THEN "
        "named_struct('kind', 'CONS', 'text', 'Small ' || p_brand) END), a -> a IS NOT NULL) AS analysis",
        "array(named_struct('question', 'What is ' || p_name || '?', 'answer', 'A ' || p_type || '.')) AS faqs",
    ]
    return t.part.selectExpr(*[f"{v} AS {k}" for k, v in SCALARS.items()], *children, "p_partkey", "p_size")


def duck(expr: str) -> str:
    return expr.replace(".0D", ".0").replace(".5D", ".5")


SQL_FACTS = "WITH f AS (SELECT *, " + ", ".join(f"{duck(v)} AS {k}" for k, v in SCALARS.items()) + "," + f"""
 list_transform(range(1, p_partkey % 3 + 2), lambda m: {{'name': 'M' || m || ' ' || p_brand, 'since': {SINCE}}}) AS fund_managers,
 list_transform(range(1, p_size % 15 + 2), lambda h: {{'name': 'H' || h, 'weight_pct': {duck(WEIGHT)}}}) AS holdings,
 """ + ", ".join(f"{duck(v)} AS {k}" for k, v in RATIOS.items()) + """,
 '+' || p_size || '.5%' AS r1, CASE WHEN p_size % 2 = 0 THEN '7%' END AS r3 FROM part),
 h AS (SELECT scheme_id, unnest(holdings) AS h FROM f),
 top AS (SELECT scheme_id, list(h.name || ' (' || coalesce(CAST(h.weight_pct AS VARCHAR), 'None') || '%)' ORDER BY h.weight_pct DESC NULLS LAST, h.name)[1:5] AS top5,
   list('- ' || h.name || ' (|, EQ): ' || coalesce(CAST(h.weight_pct AS VARCHAR), 'None') || '%' ORDER BY coalesce(h.weight_pct, 0) DESC, h.name)[1:10] AS top10 FROM h GROUP BY scheme_id),
 mg AS (SELECT scheme_id, string_agg(m.name || ' (since ' || m.since || ')', ', ' ORDER BY m.since, m.name) AS managers FROM (SELECT scheme_id, unnest(fund_managers) AS m FROM f) GROUP BY scheme_id)
"""
SQL_RATIO_LIST = "concat_ws(', ', " + ", ".join(
    f"'{r.replace('_', ' ')} ' || CAST({r} AS VARCHAR)" for r in P.RATIO_FIELDS) + ")"
SQL_SENTENCES = SQL_FACTS + f""", s AS (SELECT f.*, unnest([
 {{'field': 'expense_ratio', 'sentence': 'The expense ratio of ' || scheme_name || ' is ' || expense_ratio || '.'}},
 {{'field': 'exit_load', 'sentence': 'The exit load of ' || scheme_name || ' is: Nil after ' || p_size || ' days.'}},
 {{'field': 'min_investment', 'sentence': 'For ' || scheme_name || ', the minimum SIP is ₹' || format('{{:,}}', min_sip) || ', the minimum first (lumpsum) investment is ₹'
   || format('{{:,}}', min_lumpsum) || ', and additional investments start at ₹' || format('{{:,}}', min_additional) || '.'}},
 {{'field': 'lock_in', 'sentence': scheme_name || ' has ' || coalesce('a lock-in period of ' || lock_in, 'no lock-in period') || '.'}},
 {{'field': 'riskometer', 'sentence': 'The riskometer rating of ' || scheme_name || ' is ' || riskometer || '.'}},
 {{'field': 'benchmark', 'sentence': 'The benchmark of ' || scheme_name || ' is the ' || benchmark || '.'}},
 {{'field': 'nav', 'sentence': 'The NAV of ' || scheme_name || ' was ₹' || format('{{:,.2f}}', nav) || ' as of ' || nav_date || '.'}},
 {{'field': 'aum', 'sentence': 'The fund size (AUM) of ' || scheme_name || ' is ₹' || format('{{:,.2f}}', aum_cr) || ' Cr.'}},
 {{'field': 'category', 'sentence': scheme_name || ' is ' || CASE WHEN lower(left(category, 1)) IN ('a','e','i','o','u') THEN 'an' ELSE 'a' END || ' ' || category || ' fund in the ' || sub_category || ' category (Direct plan).'}},
 {{'field': 'launch_date', 'sentence': scheme_name || ' was launched on ' || launch_date || '.'}},
 {{'field': 'objective', 'sentence': 'Investment objective of ' || scheme_name || ': ' || objective}},
 {{'field': 'tax', 'sentence': 'Tax implication for ' || scheme_name || ': ' || tax_implication}},
 {{'field': 'stamp_duty', 'sentence': 'Stamp duty on investments in ' || scheme_name || ' is 0.005%.'}},
 {{'field': 'registrar', 'sentence': 'The registrar and transfer agent (RTA) for ' || scheme_name || ' is ' || registrar || ' (rta.example), which issues account statements.'}},
 {{'field': 'fund_managers', 'sentence': scheme_name || ' is managed by ' || managers || '.'}},
 {{'field': 'top_holdings', 'sentence': 'The top ' || len(top5) || ' holdings of ' || scheme_name || ' (as of 2024-01-31) are ' || array_to_string(top5, ', ') || '.'}},
 {{'field': 'returns', 'sentence': 'Annualised returns of ' || scheme_name || ' as published on the source page: 1Y ' || r1 || coalesce(', 3Y ' || r3, '') || '. Past performance does not indicate future returns.'}},
 {{'field': 'risk_ratios', 'sentence': 'Risk ratios of ' || scheme_name || ' published by the source page: ' || {SQL_RATIO_LIST} || '.'}}
 ]) AS x FROM f JOIN top USING (scheme_id) JOIN mg USING (scheme_id))"""


@query("fact_sentence", SQL_SENTENCES + "SELECT scheme_id, x.field AS field, x.sentence AS sentence FROM s")
def fact_sentence(t: Tables):
    fields = F.array(*[F.lit(f) for f in X.FACT_SENTENCES])
    return facts_from_part(t).withColumn("field", F.explode(fields)).select(
        "scheme_id", "field", O.fact_sentence(F.col("field")).alias("sentence"))


# Each order asks about the parts of two keys derived from it, one of them unknown now and then.
REQUEST_IDS = "array('part-' || cast(o_orderkey % 2500 as string), 'part-' || cast(o_custkey as string))"
REQUEST_FIELDS = """CASE o_orderkey % 4 WHEN 0 THEN array('expense_ratio', 'nav') WHEN 1 THEN array('lock_in', 'colour')
 WHEN 2 THEN array('fund_managers') ELSE array('top_holdings', 'aum', 'category') END"""


def requests(t: Tables):
    return t.orders.selectExpr("o_orderkey AS qid", f"{REQUEST_IDS} AS scheme_ids", f"{REQUEST_FIELDS} AS fact_fields")


SQL_ANSWERS = SQL_SENTENCES + f""", q AS (SELECT o_orderkey AS qid, unnest({REQUEST_IDS.replace('array(', '[').replace("as string))", "as string)]")}) AS scheme_id,
   generate_subscripts([1, 2], 1) - 1 AS scheme_pos, {REQUEST_FIELDS.replace("array(", "[").replace("')", "']")} AS fields FROM orders),
 q2 AS (SELECT qid, scheme_id, scheme_pos, unnest(fields) AS field, generate_subscripts(fields, 1) - 1 AS field_pos FROM q),
 ans AS (SELECT qid, scheme_pos, field_pos, scheme_id, scheme_name, x.field AS field, x.sentence AS sentence, source_url, left(scraped_at, 10) AS scraped_at
         FROM q2 JOIN s USING (scheme_id) WHERE x.field = q2.field)"""


@query("fields_cross", SQL_ANSWERS + "SELECT qid, CAST(scheme_pos AS INTEGER) AS scheme_pos, CAST(field_pos AS INTEGER) AS field_pos, scheme_id, sentence FROM ans")
def fields_cross(t: Tables):
    return O.fields_cross(requests(t), facts_from_part(t)).select("qid", "scheme_pos", "field_pos", "scheme_id", "sentence")


@query("facts_to_documents", SQL_FACTS + f""", d AS (SELECT scheme_id, scheme_name, source_url, left(scraped_at, 10) AS scraped_at, unnest([
 {{'section': 'overview', 'title': scheme_name || ': key facts', 'text': scheme_name || ' is a ' || category || ' fund (' || sub_category || ') from ' || fund_house || ', Direct plan, launched on '
  || launch_date || '.' || chr(10) || 'Riskometer: ' || riskometer || '. Benchmark: ' || benchmark || '.' || chr(10) || 'Expense ratio: ' || expense_ratio || '. Exit load: ' || exit_load
  || '. Stamp duty: 0.005%.' || chr(10) || 'Lock-in: ' || coalesce(lock_in, 'no lock-in period') || '.' || chr(10) || 'Minimum SIP: ₹' || format('{{:,}}', min_sip)
  || '. Minimum first (lumpsum) investment: ₹' || format('{{:,}}', min_lumpsum) || '. Minimum additional investment: ₹' || format('{{:,}}', min_additional) || '.' || chr(10)
  || 'NAV: ₹' || format('{{:,}}', CAST(floor(nav) AS BIGINT)) || regexp_extract(CAST(nav AS VARCHAR), '\\.\\d+$') || ' as of ' || nav_date || '. Fund size (AUM): ₹' || format('{{:,}}', CAST(floor(aum_cr) AS BIGINT))
  || regexp_extract(CAST(aum_cr AS VARCHAR), '\\.\\d+$') || ' Cr.' || chr(10) || 'Tax implication: ' || tax_implication || chr(10) || 'Registrar & transfer agent (RTA): ' || registrar || ' (rta.example).'}},
 {{'section': 'objective', 'title': scheme_name || ': investment objective', 'text': 'Investment objective of ' || scheme_name || ': ' || objective}},
 {{'section': 'performance', 'title': scheme_name || ': returns and rankings', 'text': scheme_name || ': annualised returns and category rank as shown on the source page.' || chr(10)
  || 'Fund returns: 1Y ' || r1 || coalesce(', 3Y ' || r3, '') || chr(10) || 'Rank: 1Y ' || (p_partkey % 9) || chr(10) || 'Risk ratios: ' || {SQL_RATIO_LIST} || '.' || chr(10)
  || 'Analysis:' || chr(10) || '- Pro: Cheap ' || p_name || CASE WHEN p_size % 2 = 1 THEN chr(10) || '- Con: Small ' || p_brand ELSE '' END}},
 {{'section': 'fund_managers', 'title': scheme_name || ': fund managers', 'text': 'Fund managers of ' || scheme_name || ':' || chr(10) || array_to_string(list_transform(fund_managers,
   lambda m: '- ' || m.name || ' (managing since ' || m.since || '). Education: MBA. Experience: Years ' || p_size || '.'), chr(10))}},
 {{'section': 'holdings', 'title': scheme_name || ': top holdings', 'text': 'Top ' || len(top10) || ' holdings of ' || scheme_name || ' (portfolio as of 2024-01-31, ' || len(holdings)
  || ' holdings in total):' || chr(10) || replace(array_to_string(top10, chr(10)), '|', p_type)}}]) AS d FROM f JOIN top USING (scheme_id))
SELECT substr(sha1(concat_ws('|', source_url, d.section, d.title, '0')), 1, 16) AS id, scheme_id, d.section AS section, d.title AS title, d.text AS page_content, scraped_at FROM d""")
def facts_to_documents(t: Tables):
    return O.facts_to_documents(facts_from_part(t)).select(
        "id", "scheme_id", "section", "title", "page_content", "scraped_at")


@query("table_row_documents", SQL_FACTS + f""", d AS (SELECT scheme_id, unnest(
 [{{'section': 'overview', 'part': 0, 'detail': NULL, 'text': 'Scheme Overview:' || chr(10) || scheme_name || chr(10) || chr(10) || 'Category: ' || category || chr(10) || 'Sub-category: ' || sub_category || chr(10)
   || 'Risk Level: ' || riskometer || chr(10) || chr(10) || 'NAV: ' || nav || ' (as on ' || nav_date || ')' || chr(10) || 'Rating: ' || rating || chr(10) || 'Minimum SIP Amount: ' || min_sip || chr(10) || 'Fund Size: ' || aum_cr}},
  {{'section': 'holdings', 'part': 0, 'detail': CAST(len(holdings) AS VARCHAR), 'text': 'Holdings of ' || scheme_name || ':' || chr(10) || chr(10) || array_to_string(list_transform(holdings,
   lambda h: h.name || ' | ' || p_type || ' | EQ | ' || coalesce(CAST(h.weight_pct AS VARCHAR), 'None') || '%'), chr(10)) || chr(10) || chr(10) || 'Total Holdings Reported: ' || p_size || chr(10) || 'Total Holdings Extracted: ' || len(holdings)}},
  {{'section': 'advanced_ratios', 'part': 0, 'detail': NULL, 'text': 'Advanced Ratios:' || chr(10) || chr(10) || 'Sharpe Ratio: ' || sharpe_ratio || chr(10) || 'Sortino Ratio: None' || chr(10) || 'Alpha: ' || coalesce(CAST(alpha AS VARCHAR), 'None')
   || chr(10) || 'Beta: 1.5' || chr(10) || 'Standard Deviation: ' || standard_deviation || chr(10) || 'Information Ratio: None' || chr(10) || 'Risk Rating: ' || rating || ' (' || riskometer || ')'}}]
 || list_transform([{{'i': 0, 'm': 'Fund returns', 'p': '1Y', 'v': r1}}, {{'i': 1, 'm': 'Fund returns', 'p': '3Y', 'v': r3}}, {{'i': 2, 'm': 'Rank', 'p': '1Y', 'v': CAST(p_partkey % 9 AS VARCHAR)}}, {{'i': 3, 'm': 'Rank', 'p': '3Y', 'v': NULL}}],
   lambda r: {{'section': 'returns_and_rankings', 'part': r.i, 'detail': r.p, 'text': 'Returns Information:' || chr(10) || chr(10) || 'Category: ' || category || chr(10) || 'Return Type: annualised' || chr(10) || 'Period: ' || r.p || chr(10)
   || r.m || ': ' || coalesce(r.v, 'None')}})
 || list_transform(fund_managers, lambda m, i: {{'section': 'fund_management', 'part': CAST(i - 1 AS INTEGER), 'detail': m.name, 'text': 'Fund Manager:' || chr(10) || m.name || chr(10) || chr(10) || 'Tenure: ' || m.since || chr(10)
   || 'Education: MBA.' || chr(10) || 'Experience: Years ' || p_size || '.'}})
 || [{{'section': 'faqs', 'part': 0, 'detail': 'What is ' || p_name || '?', 'text': 'Question:' || chr(10) || 'What is ' || p_name || '?' || chr(10) || chr(10) || 'Answer:' || chr(10) || 'A ' || p_type || '.'}}]) AS d FROM f)
SELECT scheme_id, d.section AS section, d.part AS part, d.detail AS detail, d.text AS text FROM d""")
def table_row_documents(t: Tables):
    return O.table_row_documents(facts_from_part(t)).select("scheme_id", "section", "part", "detail", "text")


@query("json_documents", """
WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS last_updated, unnest([
 {'part': 0, 'section': 'overview', 'text': '{' || chr(10) || '  "o_orderkey": ' || o_orderkey || ',' || chr(10) || '  "o_orderstatus": "' || o_orderstatus || '",' || chr(10) || '  "o_totalprice": ' || o_totalprice || ',' || chr(10)
   || '  "customer": {' || chr(10) || '    "key": ' || o_custkey || ',' || chr(10) || '    "note": null' || chr(10) || '  }' || chr(10) || '}'},
 {'part': 1, 'section': 'investment_objective', 'text': 'Serve ' || o_orderpriority},
 {'part': 2, 'section': 'faq', 'text': 'Question: Who ordered ' || o_orderkey || '?' || chr(10) || chr(10) || 'Answer: Customer ' || o_custkey || '.'}]) AS d FROM orders)
SELECT o_orderkey, d.part AS part, d.section AS section, d.text AS text, last_updated FROM d""")
def json_documents(t: Tables):
    o = t.orders.withColumn("customer", F.struct(F.col("o_custkey").alias("key"), F.lit(None).cast("string").alias("note")))
    faqs = F.array(F.struct(
        F.concat(F.lit("Who ordered "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("question"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(".")).alias("answer")))
    return O.json_documents(o, "o_orderkey", ["o_orderkey", "o_orderstatus", "o_totalprice", "customer"],
                            F.concat(F.lit("Serve "), F.col("o_orderpriority")), faqs, F.date_format("o_orderdate", "yyyy-MM-dd"))


# A page with embedded JSON per part.
PAGE = """'<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"scheme_name":"  ' || p_name || ' ","category":"' || p_type
 || ' ","benchmark_name":"B","expense_ratio":' || CASE WHEN p_size % 7 = 0 THEN '0' ELSE '0.' || cast(10 + p_size as string) END || ',"aum":'
 || CASE WHEN p_size % 4 = 0 THEN '0' ELSE cast(p_partkey as string) || '.126' END || ',"nav":' || cast(p_partkey as string) || '.5,"min_sip_investment":' || cast(p_size as string)
 || ',"lock_in":' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '{"years":' || cast(p_size % 3 as string) || ',"months":0,"days":null}' END
 || ',"return_stats":[{"risk":"' || CASE WHEN p_size % 5 = 0 THEN '' ELSE 'High' END || '","beta":' || cast(p_size as string) || '.25},{"risk":"Old"}],"fund_manager_details":[{"person_name":" ' || p_brand
 || '","date_from":"2019-07-03T18:30:00.000Z","education":"E ","experience":null}],"holdings":[{"company_name":"' || p_name || '","corpus_per":' || cast(p_size as string) || '.126,"portfolio_date":"2024-01-30T18:29:00.000Z"},'
 || '{"company_name":"Z","corpus_per":null}],"analysis":null,"category_info":{"tax_impact":" T' || p_brand || '"},"stats":[{"type":"OTHER","stat_1y":9},{"type":"FUND_RETURN","stat_1y":' || cast(p_size as string) || '.5,"stat_3y":null}]}}}}</script></html>'"""


@query("project_facts", """
SELECT p_partkey, p_name AS scheme_name, p_type AS category, CASE WHEN p_size % 5 <> 0 THEN 'High Risk' END AS riskometer,
 CASE WHEN p_size % 7 <> 0 THEN regexp_replace('0.' || (10 + p_size), '0$', '') || '%' END AS expense_ratio, CASE WHEN p_size % 4 <> 0 THEN round(p_partkey + 0.126, 2)::DOUBLE END AS aum_cr,
 p_partkey + 0.5::DOUBLE AS nav, CAST(p_size AS BIGINT) AS min_sip, CASE WHEN p_size % 2 = 1 AND p_size % 3 <> 0 THEN (p_size % 3) || ' years' END AS lock_in,
 'T' || p_brand AS tax, p_brand || '|2019-07-04|E|-' AS manager, p_name || ':' || round(p_size + 0.126, 2)::DOUBLE || ' Z:-' AS holdings, '2024-01-30' AS as_of,
 p_size + 0.25::DOUBLE AS beta, 0 AS n_analysis, p_size + 0.5::DOUBLE AS json_1y, CAST(NULL AS DOUBLE) AS json_3y FROM part""")
def project_facts(t: Tables):
    f = O.project_facts(t.part.select("p_partkey", F.expr(PAGE).alias("html")), F.col("html"))
    m = F.col("fund_managers")[0]
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return f.select(
        "p_partkey", "scheme_name", "category", "riskometer", "expense_ratio", "aum_cr", "nav", "min_sip", "lock_in",
        F.col("tax_implication").alias("tax"),
        F.concat_ws("|", m["name"], m["since"], m["education"], dash(m["experience"])).alias("manager"),
        F.array_join(F.transform("holdings", lambda h: F.concat_ws(":", h["name"], dash(h["weight_pct"]))), " ").alias("holdings"),
        F.col("holdings_as_of").alias("as_of"), F.col("risk_ratios.beta").alias("beta"), F.size("analysis").alias("n_analysis"),
        F.col("json_fund_returns.1y").alias("json_1y"), F.col("json_fund_returns.3y").alias("json_3y"))


CHANGED = """'<html><script id="__NEXT_DATA__" type="application/json">' || CASE WHEN p_partkey % 9 = 8 THEN '{"props": {"data": ' ELSE '{"props":{"data":{"key":' || cast(p_partkey as string)
 || CASE WHEN p_partkey % 9 = 1 THEN '' WHEN p_partkey % 9 = 2 THEN ',"name":' || cast(p_size as string) ELSE ',"name":"' || p_name || '"' END
 || ',"size":{"n":' || CASE WHEN p_partkey % 9 = 3 THEN '"' || cast(p_size as string) || '"' WHEN p_partkey % 9 = 4 THEN 'null' ELSE cast(p_size as string) || '.5' END || '}'
 || ',"rows":[{"brand":"' || p_brand || '"}' || CASE WHEN p_partkey % 9 = 5 THEN ',{"brand":"x","more":1},{"brand":"y","more":2}' ELSE '' END || ']'
 || CASE WHEN p_partkey % 9 = 6 THEN ',"new":[]' ELSE '' END || '}}}' END || '</script></html>'"""


@query("payload_problems", """
SELECT p_partkey, '$.props.data.name' AS path, 'missing' AS problem FROM part WHERE p_partkey % 9 = 1
UNION ALL SELECT p_partkey, '$.props.data.name', 'string expected, number found' FROM part WHERE p_partkey % 9 = 2
UNION ALL SELECT p_partkey, '$.props.data.size.n', 'number expected, string found' FROM part WHERE p_partkey % 9 = 3
UNION ALL SELECT p_partkey, '$.props.data.rows[*].more', 'unknown field' FROM part WHERE p_partkey % 9 = 5
UNION ALL SELECT p_partkey, '$.props.data.new', 'unknown field' FROM part WHERE p_partkey % 9 = 6
UNION ALL SELECT p_partkey, '$', 'no payload' FROM part WHERE p_partkey % 9 = 7 UNION ALL SELECT p_partkey, '$', 'no JSON' FROM part WHERE p_partkey % 9 = 8""")
def payload_problems(t: Tables):
    """Pages whose payload lacks a field, has one of another type, a new one, or is none."""
    html = F.when(F.col("p_partkey") % 9 == 7, "<html></html>").otherwise(F.expr(CHANGED))
    shape = "key bigint, name string, size struct<n:double>, rows array<struct<brand:string>>"
    return payloads.payload_problems(t.part.withColumn("html", html), "p_partkey", F.col("html"), shape, "$.props.data")


GAPS = ["CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 13 = 1 THEN '' ELSE o_orderstatus END AS status",
        "CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price",
        "o_orderpriority AS priority", "CASE WHEN o_orderkey % 19 = 0 THEN filter(array(1), x -> false) ELSE array(1) END AS items"]
SQL_PROBLEMS = """SELECT o_orderkey, 'missing status' AS problem FROM orders WHERE o_orderkey % 13 IN (0, 1)
 UNION ALL SELECT o_orderkey, 'missing price' FROM orders WHERE o_orderkey % 17 = 0 OR o_totalprice IS NULL
 UNION ALL SELECT o_orderkey, 'no items' FROM orders WHERE o_orderkey % 19 = 0"""


def order_problems(t: Tables):
    gappy = t.orders.selectExpr("o_orderkey", *GAPS)
    return O.required_fields(gappy, "o_orderkey", ["status", "price", "priority"], {"items": "no items"})


@query("required_fields", SQL_PROBLEMS)
def required_fields(t: Tables):
    return order_problems(t)


@query("publish_if_valid", f"""WITH p AS ({SQL_PROBLEMS}) SELECT 'gappy' AS collection, 0 AS written, count(*) AS n FROM p
UNION ALL SELECT 'clean', 1, count(*) FROM orders""")
def publish_if_valid(t: Tables):
    spark, collection = t.spark, Snapshots(t.spark, scratch_path(t.spark, "published"))
    gappy = Checked(t.orders.selectExpr("o_orderkey", *GAPS), "o_orderkey", O.missing(["status", "price", "priority"], {"items": "no items"}))
    clean = Checked(t.orders, "o_orderkey", O.missing(["o_orderstatus", "o_totalprice"]))
    rows = []
    for name, table in (("gappy", gappy), ("clean", clean)):
        try:
            collection.publish({name: table})
            df, written = collection.read(name), 1
        except publish.Rejected as rejected:
            df, written = spark.read.parquet(rejected.report), 0
        rows.append(df.groupBy(F.lit(name).alias("collection"), F.lit(written).alias("written")).agg(F.count("*").alias("n")))
    return rows[0].unionByName(rows[1])


@query("snapshot_versions", """
WITH g AS (SELECT o_orderkey % 5 AS k, o_totalprice FROM orders) SELECT 'first' AS seen, 'orders' AS table_name, count(*) AS n_rows FROM orders
UNION ALL SELECT 'first', 'customers', count(*) FROM customer UNION ALL SELECT 'after rejection', 'orders', count(*) FROM orders
UNION ALL SELECT 'after rejection', 'customers', count(*) FROM customer UNION ALL SELECT 'second', 'orders', count(*) FROM g WHERE k <> 0
UNION ALL SELECT 'second', 'customers', count(*) FROM customer WHERE c_custkey % 2 = 1""")
def snapshot_versions(t: Tables):
    """Tables that fit together as readers see them: at first, after a publication that a check rejects, and after the next one."""
    collection = Snapshots(t.spark, scratch_path(t.spark, "collection"))
    priced = O.missing(["o_totalprice"])
    seen = []

    def look(name):
        tables = [collection.read(x).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("seen"), F.lit(x).alias("table_name"), "n_rows")
                  for x in ("orders", "customers")]
        seen.extend(tables)

    collection.publish({"orders": Checked(t.orders, "o_orderkey", priced), "customers": t.customer})
    look("first")
    gaps = t.orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")))
    try:
        collection.publish({"customers": t.customer.where("c_custkey % 2 = 1"), "orders": Checked(gaps, "o_orderkey", priced)})
    except publish.Rejected:
        look("after rejection")
    collection.publish({"customers": t.customer.where("c_custkey % 2 = 1"), "orders": Checked(t.orders.where("o_orderkey % 5 <> 0"), "o_orderkey", priced)})
    look("second")
    out = seen[0]
    for one in seen[1:]:
        out = out.unionByName(one)
    return out


@query("explode_children", SQL_FACTS + """, h2 AS (SELECT scheme_id, unnest(holdings) AS h, generate_subscripts(holdings, 1) - 1 AS ord FROM f)
SELECT scheme_id, CAST(ord AS INTEGER) AS ord, h.name AS name, p_type AS sector, 'EQ' AS instrument, h.weight_pct AS weight_pct FROM h2 JOIN f USING (scheme_id)""")
def explode_children(t: Tables):
    return O.explode_children(facts_from_part(t), "scheme_id", "holdings")


@query("rebuild_tables", SQL_FACTS + """
SELECT 'schemes' AS table_name, count(*) AS n_rows FROM f UNION ALL SELECT 'fund_managers', CAST(sum(len(fund_managers)) AS BIGINT) FROM f
UNION ALL SELECT 'holdings', CAST(sum(len(holdings)) AS BIGINT) FROM f UNION ALL SELECT 'returns', 4 * count(*) FROM f
UNION ALL SELECT 'risk_ratios', count(*) FROM f UNION ALL SELECT 'analysis', CAST(sum(1 + p_size % 2) AS BIGINT) FROM f""")
def rebuild_tables(t: Tables):
    return publish.rebuild_tables(t.spark, O.fact_tables(materialize(facts_from_part(t), "facts")))
