"""Routing, answer assembly and streaming queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import screening as G
from corpusmill.functions import templates as X
from corpusmill.functions import text as T
from corpusmill.operators import answers as A
from corpusmill.operators import dense, evaluation
from corpusmill.operators import facts as O
from corpusmill.operators import relational as R
from corpusmill.operators.keyed import KeyedTable
from corpusmill.plans import compose as C
from corpusmill.plans import facts as PF
from corpusmill.plans import retrieval as PR
from corpusmill.plans.registry import Tables, query
from corpusmill.session import scratch_path
from corpusmill.streaming import screen, sessions

HOUSE = A.House(house="acme fund", site="Site", example="A", schemes="A and B")


def sql_footer(body: str, url: str, date: str = "NULL") -> str:
    return f"{body} || chr(10) || chr(10) || 'Source: ' || {url} || coalesce(chr(10) || 'Last updated from sources: ' || {date}, '')"


def sql_final(body: str) -> str:
    """Body of a finalized answer that gives no advice."""
    return f"list_transform([{C.sql_sentences(C.sql_strip_links(body))}], lambda ss: {C.sql_limit('ss')})[1]"


# ---- routing ----

INTENT = "CASE o_orderkey % 7 WHEN 0 THEN 'EXPLAIN' WHEN 1 THEN 'ADVICE' WHEN 2 THEN 'PERFORMANCE_COMPARISON' WHEN 3 THEN 'OFF_TOPIC' WHEN 4 THEN 'SMALL_TALK' ELSE 'FACT' END"
FIELDS = "CASE o_custkey % 3 WHEN 0 THEN array('nav') WHEN 1 THEN array('nav', 'aum') ELSE filter(array('x'), f -> false) END"
IDS = "CASE o_custkey % 4 WHEN 0 THEN array(o_orderstatus) ELSE filter(array('x'), f -> false) END"


@query("route_decision", f"""
WITH r AS (SELECT o_orderkey, {INTENT} AS intent, CASE o_custkey % 3 WHEN 0 THEN ['nav'] WHEN 1 THEN ['nav', 'aum'] ELSE [] END AS f,
 CASE o_custkey % 4 WHEN 0 THEN [o_orderstatus] ELSE [] END AS i, o_orderkey % 5 = 0 AS every FROM orders),
 a AS (SELECT *, CASE WHEN intent = 'FACT' AND every AND len(i) = 0 THEN ['*'] ELSE i END AS ids FROM r)
SELECT o_orderkey, array_to_string(ids, ',') AS ids, CASE intent WHEN 'EXPLAIN' THEN 'retrieval' WHEN 'ADVICE' THEN 'refuse_advice' WHEN 'PERFORMANCE_COMPARISON' THEN 'refuse_comparison'
 WHEN 'OFF_TOPIC' THEN 'off_topic' WHEN 'SMALL_TALK' THEN 'small_talk' ELSE CASE WHEN len(f) = 0 THEN 'retrieval' WHEN len(ids) = 0 THEN 'ask_scheme' ELSE 'sql_fact' END END AS handler FROM a""")
def route_decision(t: Tables):
    r = t.orders.selectExpr("o_orderkey", f"{INTENT} AS intent", f"{FIELDS} AS fact_fields", f"{IDS} AS scheme_ids", "o_orderkey % 5 = 0 AS all_schemes")
    return A.route_decision(r).select("o_orderkey", F.array_join("scheme_ids", ",").alias("ids"), "handler")


# Three parts per order.
PART = "named_struct('question', 'q{n}', 'handler', {h}, 'scheme_ids', {i}, 'fact_fields', {f})"
HANDLERS = ["CASE WHEN o_orderkey % 5 = 0 THEN 'retrieval' ELSE 'sql_fact' END", "CASE WHEN o_orderkey % 3 = 0 THEN 'retrieval' ELSE 'sql_fact' END", "'sql_fact'"]
PART_IDS = ["array('s' || cast(o_custkey % 2 as string))", "array('s' || cast(o_orderkey % 2 as string))", "array('s1', 's' || cast(o_custkey % 3 as string))"]
PART_FIELDS = ["array('f' || cast(o_custkey % 3 as string))", "array('f' || cast(o_orderkey % 3 as string), 'g')", "array('f' || cast(o_orderkey % 2 as string))"]
PARTS = "array(" + ", ".join(PART.format(n=n + 1, h=HANDLERS[n], i=PART_IDS[n], f=PART_FIELDS[n]) for n in range(3)) + ")"
_sql_part = lambda n: f"{{'q': 'q{n + 1}', 'h': {HANDLERS[n]}, 'i': {PART_IDS[n].replace('array(', '[')[:-1]}], 'f': {PART_FIELDS[n].replace('array(', '[')[:-1]}]}}"
SQL_SAME = lambda a, b: f"list_sort(list_distinct({a})) = list_sort(list_distinct({b}))"
_new = lambda a, b: f"list_concat({a}, list_filter({b}, lambda x: NOT list_contains({a}, x)))"
SQL_JOINS = f"(m.h = 'sql_fact' AND e.l[1].h = 'sql_fact' AND ({SQL_SAME('m.i', 'e.l[1].i')} OR {SQL_SAME('m.f', 'e.l[1].f')}))"


def sql_merge_routes(parts: str) -> str:
    at = f"coalesce(list_position(list_transform(a.l, lambda m: {SQL_JOINS}), true), 0)"
    merged = f"{{'q': m.q || ' ' || e.l[1].q, 'h': m.h, 'i': {_new('m.i', 'e.l[1].i')}, 'f': {_new('m.f', 'e.l[1].f')}}}"
    step = (f"CASE WHEN {at} = 0 THEN {{'l': list_concat(a.l, e.l)}} ELSE {{'l': list_transform(a.l, lambda m, k: CASE WHEN k = {at} THEN {merged} ELSE m END)}} END")
    return f"list_reduce(list_transform({parts}, lambda x: {{'l': [x]}}), lambda a, e: {step}).l"


@query("merge_fact_routes", f"""
WITH p AS (SELECT o_orderkey, {sql_merge_routes('[' + ', '.join(_sql_part(n) for n in range(3)) + ']')} AS l FROM orders)
SELECT o_orderkey, array_to_string(list_transform(l, lambda r: r.q || ':' || r.h || ':' || array_to_string(list_distinct(r.i || []), '+') || ':' || array_to_string(r.f, '+')), ' ; ') AS routes FROM p""".replace(
    "list_distinct(r.i || [])", "r.i"))
def merge_fact_routes(t: Tables):
    merged = A.merge_fact_routes(F.expr(PARTS))
    return t.orders.select("o_orderkey", F.array_join(F.transform(merged, lambda r: F.concat_ws(
        ":", r["question"], r["handler"], F.array_join(r["scheme_ids"], "+"), F.array_join(r["fact_fields"], "+"))), " ; ").alias("routes"))


PLAN_HANDLERS = ["CASE conv_id % 4 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'small_talk' WHEN 2 THEN 'off_topic' ELSE 'retrieval' END",
                 "CASE turn % 5 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'refuse_comparison' WHEN 2 THEN 'small_talk' ELSE 'retrieval' END",
                 "CASE (conv_id + turn) % 7 WHEN 0 THEN 'refuse_advice' WHEN 1 THEN 'small_talk' ELSE 'retrieval' END"]


@query("message_refusal", f"""
WITH h AS (SELECT conv_id, turn, [{', '.join(PLAN_HANDLERS)}][1:1 + turn % 3] AS h FROM conversations)
SELECT conv_id, turn, CASE WHEN list_contains(h, 'refuse_advice') THEN 'refuse_advice' WHEN list_contains(h, 'refuse_comparison') THEN 'refuse_comparison' END AS refusal,
 CASE WHEN list_contains(h, 'refuse_advice') OR list_contains(h, 'refuse_comparison') THEN NULL WHEN len(h) > 1 AND len(list_filter(h, lambda x: x <> 'retrieval')) = 0 THEN 'whole:retrieval'
  WHEN len(h) > 1 AND len(list_filter(h, lambda x: x <> 'small_talk')) > 0 THEN array_to_string(list_transform(list_filter(h, lambda x: x <> 'small_talk'), lambda x: 'part:' || x), ',')
  ELSE 'part:' || h[1] END AS handlers FROM h""")
def message_refusal(t: Tables):
    none = "cast(array() as array<string>)"
    route = lambda q, h: f"named_struct('question', '{q}', 'handler', {h}, 'scheme_ids', {none}, 'fact_fields', {none})"
    parts = F.expr(f"slice(array({', '.join(route('part', h) for h in PLAN_HANDLERS)}), 1, cast(1 + turn % 3 as int))")
    plan = A.message_plan(parts, F.expr(route("whole", "'retrieval'")))
    return t.conversations.select("conv_id", "turn", plan.alias("p")).select(
        "conv_id", "turn", "p.refusal", F.array_join(F.transform("p.routes", lambda r: F.concat_ws(":", r["question"], r["handler"])), ",").alias("handlers"))


# ---- answers ----

GIVEN = "CASE conv_id % 4 WHEN 0 THEN 'It costs 1,5' || cast(turn as string) || '0 or 2.5%.' WHEN 1 THEN '  ' WHEN 2 THEN 'Plain answer.' ELSE 'About ' || cast(conv_id as string) || ' of 7.' END"
SOURCES = ["'Price 15' || cast(turn as string) || '0 and 2.5 percent ' || text", "role || ' 7 ' || cast(conv_id as string)"]


@query("grounding_check", rf"""
WITH a AS (SELECT conv_id, turn, conv_id % 9 <> 0 AS found, {GIVEN} AS answer, CASE WHEN turn % 6 < 5 THEN turn % 4 END AS sid, [{', '.join(SOURCES)}] AS src FROM conversations),
 n AS (SELECT *, list_transform(regexp_extract_all(answer, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')) AS said,
  list_transform(flatten(list_transform(src, lambda s: regexp_extract_all(s, '\d[\d,]*(?:\.\d+)?'))), lambda x: replace(x, ',', '')) AS known FROM a)
SELECT conv_id, turn, found AND trim(answer) <> '' AND coalesce(sid BETWEEN 1 AND 2, false) AND len(list_filter(said, lambda x: NOT list_contains(known, x))) = 0 AS ok FROM n""")
def grounding_check(t: Tables):
    return t.conversations.select("conv_id", "turn", A.grounding_check(
        F.expr("conv_id % 9 <> 0"), F.expr(GIVEN), F.expr("CASE WHEN turn % 6 < 5 THEN turn % 4 END"),
        F.expr(f"array({', '.join(SOURCES)})")).alias("ok"))


SQL_ASSEMBLED = PF.SQL_ANSWERS + f""", g AS (SELECT qid, count(DISTINCT scheme_id) AS n, string_agg(sentence, ' ' ORDER BY scheme_pos, field_pos) AS para, string_agg('- ' || sentence, chr(10) ORDER BY scheme_pos, field_pos) AS bullets,
  first(source_url ORDER BY scheme_pos, field_pos) AS url, max(scraped_at) AS updated FROM ans GROUP BY qid),
 b AS (SELECT *, CASE WHEN n = 1 THEN para ELSE bullets END AS raw, CASE WHEN n = 1 THEN url ELSE 'https://example.com/list' END AS cite FROM g),
 c AS (SELECT *, {sql_final('raw')} AS body FROM b)"""


@query("assemble_answers", SQL_ASSEMBLED + f" SELECT qid, body, cite AS citation_url, {sql_footer('body', 'cite', 'updated')} AS text FROM c")
def assemble_answers(t: Tables):
    pairs = O.fields_cross(PF.requests(t), PF.facts_from_part(t))
    return A.assemble_answers(pairs, HOUSE).select("qid", "body", "citation_url", "text")


@query("answer_every_scheme", PF.SQL_SENTENCES + f""", l AS (SELECT DISTINCT {PF.REQUEST_FIELDS.replace("array(", "[").replace("')", "']")} AS fields FROM orders),
 p AS (SELECT fields, unnest(fields) AS field, generate_subscripts(fields, 1) AS pos FROM l),
 e AS (SELECT fields, x.sentence AS sentence, row_number() OVER (PARTITION BY fields ORDER BY scheme_id, pos) AS rn, max(left(scraped_at, 10)) OVER () AS updated
       FROM p JOIN s ON x.field = p.field WHERE x.sentence IS NOT NULL),
 g AS (SELECT fields, string_agg('- ' || sentence, chr(10) ORDER BY rn) FILTER (rn <= 12) AS raw, max(updated) AS updated FROM e GROUP BY fields),
 c AS (SELECT *, {sql_final('raw')} AS body FROM g)
SELECT o_orderkey AS qid, body, {sql_footer('body', "'https://example.com/list'", 'updated')} AS text FROM orders JOIN c ON fields = {PF.REQUEST_FIELDS.replace("array(", "[").replace("')", "']")}""")
def answer_every_scheme(t: Tables):
    return A.answer_every_scheme(PF.requests(t), PF.facts_from_part(t), HOUSE).select("qid", "body", "text")


@query("format_answer_rows", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'I could not find the requested information in the structured database. ' WHEN 1 THEN 'The requested information for ' || o_orderstatus || ' is ' || o_orderpriority || '. '
 WHEN 2 THEN 'Here is the requested information:' || chr(10) || '- ' || o_orderstatus || ': ' || o_orderpriority || ' (' || o_custkey || ')'
 ELSE 'Here is the requested information:' || chr(10) || '- ' || o_orderstatus || ': ' || o_orderpriority || chr(10) || '- B: ' || o_custkey END || chr(10) || 'Last updated from sources: x' AS text FROM orders""")
def format_answer_rows(t: Tables):
    rows = F.expr("""CASE o_orderkey % 4
      WHEN 0 THEN filter(array(named_struct('name', '', 'value', '', 'extra', cast(NULL as string))), x -> false)
      WHEN 1 THEN array(named_struct('name', o_orderstatus, 'value', o_orderpriority, 'extra', cast(NULL as string)))
      WHEN 2 THEN array(named_struct('name', o_orderstatus, 'value', o_orderpriority, 'extra', cast(o_custkey as string)))
      ELSE array(named_struct('name', o_orderstatus, 'value', o_orderpriority, 'extra', cast(NULL as string)), named_struct('name', 'B', 'value', cast(o_custkey as string), 'extra', cast(NULL as string))) END""")
    return t.orders.withColumn("r", rows).select("o_orderkey", A.format_rows(F.col("r"), F.lit("\nLast updated from sources: x")).alias("text"))


OLD_INTENT = "CASE o_orderkey % 6 WHEN 0 THEN 'NAV' WHEN 1 THEN 'EXPENSE_RATIO' WHEN 2 THEN 'FUND_MANAGER' WHEN 3 THEN 'HOLDINGS' ELSE 'GENERAL' END"
OLD_MESSAGE = "o_orderpriority || CASE WHEN o_orderkey % 11 = 0 THEN ' call me on 9876543210' ELSE '' END"
OLD_IDS = f"CASE WHEN o_orderkey % 5 = 0 THEN filter(array(''), x -> false) WHEN o_orderkey % 7 = 0 THEN array('part-' || cast(o_custkey as string)) ELSE {PF.REQUEST_IDS} END"
SQL_OLD_REFUSAL = C.lit(X.OLD_PII_REPLY.format(house=HOUSE.house, site=HOUSE.site, link=HOUSE.links["list"]))


@query("structured_or_retrieved", PF.SQL_FACTS + f""",
 rw AS (SELECT scheme_id, 'NAV' AS intent, 1 AS pos, scheme_name AS name, category AS value, launch_date AS extra FROM f
  UNION ALL SELECT scheme_id, 'EXPENSE_RATIO', 1, scheme_name, expense_ratio, NULL FROM f
  UNION ALL SELECT scheme_id, 'FUND_MANAGER', unnest(range(1, len(fund_managers) + 1)), scheme_name, unnest(list_transform(fund_managers, lambda m: m.name)), unnest(list_transform(fund_managers, lambda m: m.since)) FROM f),
 q AS (SELECT o_orderkey AS qid, o_orderstatus AS said, o_orderkey % 11 = 0 AS pii, {OLD_INTENT} AS intent,
  CASE WHEN o_orderkey % 5 = 0 THEN [] WHEN o_orderkey % 7 = 0 THEN ['part-' || o_custkey] ELSE ['part-' || (o_orderkey % 2500), 'part-' || o_custkey] END AS ids FROM orders),
 a AS (SELECT qid, unnest(ids) AS scheme_id, generate_subscripts(ids, 1) AS i, intent FROM q),
 r AS (SELECT qid, count(*) AS n, list(rw ORDER BY i, pos) AS rows FROM a JOIN rw USING (scheme_id, intent) GROUP BY qid)
SELECT qid, CASE WHEN pii THEN 'pii' WHEN intent <> 'GENERAL' AND len(ids) > 0 THEN 'structured' ELSE 'retrieval' END AS route,
 CASE WHEN pii THEN {SQL_OLD_REFUSAL} WHEN intent = 'GENERAL' OR len(ids) = 0 THEN 'Said ' || said
  ELSE CASE WHEN rows IS NULL THEN 'I could not find the requested information in the structured database. '
   WHEN intent = 'NAV' THEN 'The latest NAV for ' || rows[1].name || ' is ' || rows[1].value || ' as of ' || rows[1].extra || '. '
   WHEN n = 1 AND rows[1].extra IS NULL THEN 'The requested information for ' || rows[1].name || ' is ' || rows[1].value || '. '
   ELSE 'Here is the requested information:' || chr(10) || array_to_string(list_transform(rows, lambda x: '- ' || x.name || ': ' || x.value || coalesce(' (' || x.extra || ')', '')), chr(10)) END
   || chr(10) || 'Last updated from sources: x' END AS text
FROM q LEFT JOIN r USING (qid)""")
def structured_or_retrieved(t: Tables):
    facts = PF.facts_from_part(t)
    no_extra, one = F.lit(None).cast("string"), F.lit(1)

    def row(intent, pos, value, extra):
        return F.struct(F.lit(intent).alias("intent"), pos.alias("pos"), F.col("scheme_name").alias("name"), value.alias("value"), extra.alias("extra"))

    rows = facts.select("scheme_id", F.explode(F.concat(
        F.array(row("NAV", one, F.col("category"), F.col("launch_date")), row("EXPENSE_RATIO", one, F.col("expense_ratio"), no_extra)),
        F.transform("fund_managers", lambda m, i: row("FUND_MANAGER", i + 1, m["name"], m["since"])))).alias("r")).select("scheme_id", "r.*")
    questions = t.orders.selectExpr("o_orderkey AS qid", f"{OLD_MESSAGE} AS message", f"{OLD_INTENT} AS intent", f"{OLD_IDS} AS scheme_ids")
    said = t.orders.select(F.col("o_orderkey").alias("qid"), F.concat(F.lit("Said "), "o_orderstatus").alias("text"))
    return A.structured_or_retrieved(questions, rows, said, HOUSE, F.lit("\nLast updated from sources: x"))


REPLY = ["'t' || cast(conv_id % 3 as string)", "'t' || cast(turn % 3 as string)", "'t' || cast((conv_id + turn) % 2 as string)"]
DATES = ["CASE WHEN turn % 2 = 0 THEN '2026-01-0' || cast(1 + conv_id % 9 as string) END", "CASE WHEN conv_id % 2 = 0 THEN '2026-01-0' || cast(1 + turn % 9 as string) ELSE '' END", "cast(NULL as string)"]


@query("combine_parts", f"""
WITH p AS (SELECT conv_id, turn, [{', '.join(f"{{'t': {REPLY[i]}, 'b': text || {i}, 'u': 'u{i}', 'd': nullif({DATES[i]}, '')}}" for i in range(3))}] AS p FROM conversations),
 u AS (SELECT conv_id, turn, list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: y.t), x.t) = i) AS p FROM p)
SELECT conv_id, turn, array_to_string(list_transform(p, lambda x: x.t), chr(10) || chr(10)) AS text, array_to_string(list_transform(p, lambda x: x.b), chr(10) || chr(10)) AS body, p[1].u AS citation_url,
 list_max(list_filter(list_transform(p, lambda x: x.d), lambda d: d IS NOT NULL)) AS last_updated FROM u""")
def combine_parts(t: Tables):
    parts = F.expr("array(" + ", ".join(
        f"named_struct('text', {REPLY[i]}, 'body', text || '{i}', 'citation_url', 'u{i}', 'last_updated', {DATES[i]})" for i in range(3)) + ")")
    return t.conversations.select("conv_id", "turn", A.combine_parts(parts).alias("r")).select("conv_id", "turn", "r.*")


@query("format_context", f"""WITH {PR.SQL_SELF}, {PR.sql_dense('d', 'q', 'e', 5)}
SELECT qid, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM d JOIN documents ON doc_id = id GROUP BY qid""")
def format_context(t: Tables):
    hits = dense.dense_topk(PR.self_queries(t), PR.vectors(t), 5).select("qid", "id", "rank")
    return A.format_context(A.passages(hits, t.documents.select(F.col("doc_id").alias("id"), "text")), "text")


HANDLER = "CASE event_id % 7 WHEN 0 THEN 'pii' WHEN 1 THEN 'refuse_advice' WHEN 2 THEN 'refuse_comparison' WHEN 3 THEN 'off_topic' WHEN 4 THEN 'small_talk' WHEN 5 THEN 'ask_scheme' ELSE 'not_found' END"
SQL_REPLIES = "(VALUES " + ", ".join(f"('{k}', {C.lit(HOUSE.text(text))}, '{HOUSE.links[link]}')" for k, (text, link) in X.FIXED_REPLIES.items()) + ") r(handler, body, url)"


@query("fixed_reply", f"""SELECT event_id, handler, {sql_footer('body', 'url')} AS text FROM (SELECT event_id, {HANDLER} AS handler FROM events) JOIN {SQL_REPLIES} USING (handler)""")
def fixed_reply(t: Tables):
    return A.fixed_reply(t.events.select("event_id", F.expr(HANDLER).alias("handler")), HOUSE).select("event_id", "handler", "text")


ASKED = """text || CASE item_id % 8 WHEN 0 THEN ' My PAN is ABCDE1234F' WHEN 1 THEN ' Should I buy it?' WHEN 2 THEN ' nav of it' ELSE '' END"""
ASKED_INTENT = "CASE item_id % 8 WHEN 5 THEN 'EXPLAIN' WHEN 6 THEN 'OFF_TOPIC' WHEN 7 THEN 'SMALL_TALK' ELSE 'FACT' END"
MODEL_ANSWER = "CASE item_id % 3 WHEN 0 THEN 'The text says so. Second. Third. Fourth.' WHEN 1 THEN 'There are 987654321987 items.' ELSE ' A plain answer ' END"
SQL_BATCH = f"""WITH {PR.SQL_STATS}, {PR.SQL_VECS}, {PR.SQL_ASK}, w AS (SELECT item_id AS qid, {ASKED} AS message, {ASKED_INTENT} AS intent, scope,
   CASE WHEN item_id % 8 IN (2, 3) THEN ['expense_ratio', 'nav'] ELSE [] END AS fields, item_id % 5 <> 0 AS found, {MODEL_ANSWER} AS answer, 1 + item_id % 6 AS sid FROM benchmark JOIN (SELECT qid, scope FROM q) ON qid = item_id),
 hd AS (SELECT *, CASE WHEN len({C.sql_pii('message')}) > 0 THEN 'pii' ELSE coalesce({C.sql_refusal('message')}, CASE WHEN intent = 'EXPLAIN' THEN 'retrieval' WHEN intent = 'OFF_TOPIC' THEN 'off_topic' WHEN intent = 'SMALL_TALK' THEN 'small_talk'
   WHEN len(fields) = 0 THEN 'retrieval' WHEN qid % 8 = 3 THEN 'ask_scheme' ELSE 'sql_fact' END) END AS handler FROM w),
 rq AS (SELECT qid, {C.sql_terms('message')} AS terms, scope, qvec FROM hd JOIN qv USING (qid) WHERE handler = 'retrieval'),
 {PR.sql_bm25('b', 'rq', 20)}, {PR.sql_dense('d', 'rq', 'dv', 20)}, {PR.sql_fuse('h', 'd', 'b', 5)},
 bs AS (SELECT qid, max(cosine) AS best FROM d GROUP BY qid), hits AS (SELECT qid, rank, text, source FROM h JOIN documents ON doc_id = id),
 ok AS (SELECT hd.qid, hd.answer, x.source FROM hd JOIN bs USING (qid) JOIN hits x ON x.qid = hd.qid AND x.rank = sid WHERE found AND best >= 0.3 AND trim(answer) <> ''
   AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(answer, '\\d+')) AS num) s WHERE num NOT IN (SELECT unnest(regexp_extract_all(replace(y.text, ',', ''), '\\d+(?:\\.\\d+)?')) FROM hits y WHERE y.qid = hd.qid))),
 fa AS (SELECT hd.qid, p_name || ' ' || p_partkey AS name, p_partkey, p_size, p_retailprice FROM hd JOIN part ON p_partkey = hd.qid WHERE handler = 'sql_fact'),
 r AS (SELECT qid, 'sql_fact' AS handler, 'The expense ratio of ' || name || ' is 0.' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '%. The NAV of ' || name || ' was ₹' || format('{{:,.2f}}', p_retailprice) || ' as of 2024-02-0' || (1 + p_size % 9) || '.' AS body,
    'https://example.com/part/' || p_partkey AS url, '2024-03-0' || (1 + p_partkey % 9) AS d FROM fa
  UNION ALL SELECT qid, 'retrieval', {sql_final('trim(answer)')}, 'https://example.com/' || source, '2026-02-03' FROM ok
  UNION ALL SELECT f.qid, f.handler, r.body, r.url, NULL FROM (SELECT qid, CASE WHEN handler IN ('sql_fact', 'retrieval') THEN 'not_found' ELSE handler END AS handler FROM hd
    WHERE NOT (handler = 'sql_fact' AND qid IN (SELECT qid FROM fa)) AND NOT (handler = 'retrieval' AND qid IN (SELECT qid FROM ok))) f JOIN {SQL_REPLIES} USING (handler))
SELECT qid, handler, {sql_footer('body', 'url', 'd')} AS text FROM r"""


def answer_texts(t: Tables):
    return PR.documents(t, "text", F.concat(F.lit("https://example.com/"), "source").alias("source_url"), F.lit("2026-02-03T00:00:00").alias("scraped_at"))


@query("batch_answer", SQL_BATCH)
def batch_answer(t: Tables):
    q = t.benchmark.join(PR.questions(t).select(F.col("qid").alias("item_id"), "scope", "qvec"), "item_id").select(
        F.col("item_id").alias("qid"), F.expr(ASKED).alias("message"), F.expr(ASKED_INTENT).alias("intent"),
        F.expr("CASE WHEN item_id % 8 IN (2, 3) THEN array('expense_ratio', 'nav') ELSE filter(array('x'), f -> false) END").alias("fact_fields"),
        F.lit(False).alias("all_schemes"),
        F.expr("CASE item_id % 8 WHEN 2 THEN array('part-' || cast(item_id as string)) WHEN 3 THEN filter(array('x'), f -> false) ELSE scope END").alias("scheme_ids"),
        "qvec", F.expr("item_id % 5 <> 0").alias("found"), F.expr(MODEL_ANSWER).alias("answer"), F.expr("cast(1 + item_id % 6 as int)").alias("source_id"))
    return A.batch_answer(q, PF.facts_from_part(t), PR.chunks(t), HOUSE, house_names=["acme"], texts=answer_texts(t)).select("qid", "handler", "text")


def parts_of(t: Tables):
    """The questions of ``batch_answer`` as parts, with the model's output for each."""
    none = F.expr("filter(array('x'), f -> false)")
    part = F.struct(F.expr(ASKED).alias("question"), F.expr(ASKED_INTENT).alias("intent"),
                    F.when(F.expr("item_id % 8 IN (2, 3)"), F.array(F.lit("expense_ratio"), F.lit("nav"))).otherwise(none).alias("fact_fields"),
                    F.lit(False).alias("all_schemes"),
                    F.expr("CASE item_id % 8 WHEN 2 THEN array('part-' || cast(item_id as string)) WHEN 3 THEN filter(array('x'), f -> false) ELSE scope END").alias("scheme_ids"))
    return t.benchmark.join(PR.questions(t).select(F.col("qid").alias("item_id"), "scope", "qvec"), "item_id").select(
        F.col("item_id").alias("qid"), part.alias("part"), "qvec", F.expr("item_id % 5 <> 0").alias("found"), F.expr(MODEL_ANSWER).alias("answer"),
        F.expr("cast(1 + item_id % 6 as int)").alias("source_id"))


# Each message asks what one item asks and what the item two further on asks; the last two ask one thing.
SQL_MESSAGES = SQL_BATCH[:SQL_BATCH.rindex("SELECT qid, handler,")] + f""", one AS (SELECT qid, handler, {sql_footer('body', 'url', 'd')} AS text FROM r),
 pr AS (SELECT a.qid, a.handler AS h1, b.handler AS h2, x.text AS t1, y.text AS t2, x.handler AS g1, y.handler AS g2
   FROM hd a LEFT JOIN hd b ON b.qid = a.qid + 2 JOIN one x ON x.qid = a.qid LEFT JOIN one y ON y.qid = b.qid),
 st AS (SELECT *, CASE WHEN h1 = 'pii' OR h2 = 'pii' THEN 'pii' WHEN 'refuse_advice' IN (h1, h2) THEN 'refuse_advice' WHEN 'refuse_comparison' IN (h1, h2) THEN 'refuse_comparison' END AS stop FROM pr),
 fx AS (SELECT handler, {sql_footer('body', 'url')} AS text FROM {SQL_REPLIES})
SELECT qid, CASE WHEN stop IS NOT NULL THEN stop WHEN h2 IS NULL OR h2 = 'small_talk' THEN g1 WHEN h1 = 'small_talk' THEN g2 ELSE 'multi' END AS handler,
 CASE WHEN stop IS NOT NULL THEN fx.text WHEN h2 IS NULL OR h2 = 'small_talk' OR t1 = t2 THEN t1 WHEN h1 = 'small_talk' THEN t2 ELSE t1 || chr(10) || chr(10) || t2 END AS text
FROM st LEFT JOIN fx ON fx.handler = stop"""


@query("answer_messages", SQL_MESSAGES)
def answer_messages(t: Tables):
    parts = parts_of(t)
    second = parts.select((F.col("qid") - 2).alias("qid"), F.col("part").alias("other"))
    messages = parts.select("qid", "part").join(second, "qid", "left").select(
        "qid", F.concat_ws(" ", "part.question", "other.question").alias("message"), F.array_compact(F.array("part", "other")).alias("parts"),
        F.struct(F.concat_ws(" ", "part.question", "other.question").alias("question"), F.lit("EXPLAIN").alias("intent"), "part.fact_fields",
                 "part.all_schemes", "part.scheme_ids").alias("whole")).withColumn("standalone", F.col("message"))
    said = parts.select("qid", F.col("part.question").alias("question"), "qvec", "found", "answer", "source_id")
    model = said.unionByName(said.withColumn("qid", F.col("qid") - 2))
    return A.answer_messages(messages, model, PF.facts_from_part(t), PR.chunks(t), HOUSE, house_names=["acme"], texts=answer_texts(t)).select("qid", "handler", "text")


@query("judge_scorecard", f"""
WITH a AS (SELECT quality = 1 OR turn % 4 = 0 AS answered, conv_id % 3 = 0 AS cited, toxic = 0 AS faithful, quality = 1 AS relevant, len({C.sql_sentences(C.sql_strip_links('body'))}) <= 3 AS short,
  NOT {C.sql_advice('body')} AS no_advice FROM (SELECT conv_id, turn, {C.SHORT_ANSWER} AS body FROM conversations WHERE role = 'assistant') JOIN labels ON doc_id = conv_id)
SELECT count(*) AS n, count(*) FILTER (answered) AS answered, count(*) FILTER (NOT answered) AS declined, count(*) FILTER (answered AND cited) AS cited, count(*) FILTER (answered AND faithful) AS faithful,
 count(*) FILTER (answered AND relevant) AS relevant, count(*) FILTER (answered AND short) AS short, count(*) FILTER (answered AND no_advice) AS no_advice FROM a""")
def judge_scorecard(t: Tables):
    told = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.expr(C.SHORT_ANSWER).alias("body")).join(
        t.labels.withColumnRenamed("doc_id", "conv_id"), "conv_id")
    return evaluation.judge_scorecard(
        told, F.expr("quality = 1 OR turn % 4 = 0"), cited=F.expr("conv_id % 3 = 0"), faithful=F.expr("toxic = 0"), relevant=F.expr("quality = 1"),
        short=F.size(T.split_sentences(G.strip_links(F.col("body")))) <= 3, no_advice=~G.gives_advice(F.col("body")))


# ---- streams ----

def arriving(t: Tables, table: str):
    schema = getattr(t, table).schema
    # A glob, since the stream reader takes a plain path for a folder and a table may be one file or a folder of files.
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{table}.parque[t]")


@query("stream_screen", f"""SELECT conv_id, turn, array_to_string({C.sql_pii('m')}, ', ') AS kinds, {C.sql_refusal('m')} AS refusal,
 CASE WHEN len({C.sql_pii('m')}) > 0 THEN {C.lit(G.P.PII_PLACEHOLDER)} ELSE m END AS shown FROM (SELECT conv_id, turn, {C.MESSAGE} AS m FROM conversations)""")
def stream_screen(t: Tables):
    path = scratch_path(t.spark, "screened")
    out = screen.stream_screen(arriving(t, "conversations").withColumn("m", F.expr(C.MESSAGE)), F.col("m"), ["conv_id", "turn"], ["acme"])
    screen.write_batches(out, f"{path}/data", f"{path}/progress").awaitTermination()
    return t.spark.read.parquet(f"{path}/data").select("conv_id", "turn", "kinds", "refusal", "shown")


SQL_EXCHANGES = """SELECT conv_id, turn, text || CASE WHEN (conv_id + turn) % 5 = 0 THEN ' call me on 9876543210' ELSE '' END AS question, 'Reply ' || role || ' ' || text AS answer FROM conversations"""


@query("stream_sessions", f"""
WITH x AS ({SQL_EXCHANGES}), p AS (SELECT conv_id, turn, 'User: ' || question || chr(10) || 'Assistant: ' || left(answer, 300) AS s FROM x WHERE len({C.sql_pii('question')}) = 0)
SELECT conv_id, turn, array_to_string(coalesce(list(s) OVER w, []), chr(10)) AS transcript, CAST(count(s) OVER w AS INTEGER) AS n_turns FROM p
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def stream_sessions(t: Tables):
    path, conf = scratch_path(t.spark, "sessions"), "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(conf)
    t.spark.conf.set(conf, sessions.STATE_STORE)
    try:
        exchanges = arriving(t, "conversations").selectExpr(
            "conv_id", "turn", "text || CASE WHEN (conv_id + turn) % 5 = 0 THEN ' call me on 9876543210' ELSE '' END AS question",
            "'Reply ' || role || ' ' || text AS answer")
        screen.write_batches(sessions.stream_sessions(exchanges), f"{path}/data", f"{path}/progress").awaitTermination()
    finally:
        t.spark.conf.set(conf, before)
    return t.spark.read.parquet(f"{path}/data").select("conv_id", "turn", "transcript", "n_turns")


@query("ordered_sessions", f"""
WITH x AS ({SQL_EXCHANGES}), p AS (SELECT conv_id, turn, 'User: ' || question || chr(10) || 'Assistant: ' || left(answer, 300) AS s FROM x WHERE len({C.sql_pii('question')}) = 0)
SELECT conv_id, turn, array_to_string(coalesce(list(s) OVER w, []), chr(10)) AS transcript, CAST(count(s) OVER w AS INTEGER) AS n_turns FROM p
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def ordered_sessions(t: Tables):
    """By event time: a minute a turn, and one row much later, behind which the watermark passes them all."""
    path, conf = scratch_path(t.spark, "ordered"), "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(conf)
    t.spark.conf.set(conf, sessions.STATE_STORE)
    try:
        said = arriving(t, "conversations").selectExpr(
            "conv_id", "turn", "text || CASE WHEN (conv_id + turn) % 5 = 0 THEN ' call me on 9876543210' ELSE '' END AS question",
            "'Reply ' || role || ' ' || text AS answer", "timestamp_seconds(86400 + turn * 60) AS said_at")
        end = t.conversations.groupBy(F.lit(-1).cast("bigint").alias("conv_id")).agg(
            F.max("turn").alias("turn"), F.lit("").alias("question"), F.lit("").alias("answer"), F.timestamp_seconds(F.max("turn") * 60 + 7 * 86400).alias("said_at"))
        end.write.parquet(f"{path}/end")
        exchanges = said.unionByName(t.spark.readStream.schema(end.schema).parquet(f"{path}/end"))
        screen.write_batches(sessions.ordered_sessions(exchanges, "said_at"), f"{path}/data", f"{path}/progress").awaitTermination()
    finally:
        t.spark.conf.set(conf, before)
    return t.spark.read.schema(sessions.OUT).option("recursiveFileLookup", "true").parquet(f"{path}/data").where("conv_id <> -1")


@query("stream_upsert", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_upsert(t: Tables):
    path = scratch_path(t.spark, "upserts")
    rows = arriving(t, "events").select("user_id", "event_type", "ts", "event_id", "value")
    table = KeyedTable(t.spark, f"{path}/data", rows.schema, ["user_id", "event_type"], "ts", buckets=8)
    screen.upsert_stream(rows, table, f"{path}/progress", compact_every=2).awaitTermination()
    return table.read().select("user_id", "event_type", "event_id", "value")
