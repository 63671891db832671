"""Projections and scalar functions, text screening."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import patterns as P
from corpusmill.functions import scalars as S
from corpusmill.functions import screening as G
from corpusmill.functions import text as X
from corpusmill.operators import lookup
from corpusmill.plans import compose as C
from corpusmill.plans.registry import Tables, query

LINKED = """'See [' || url || '](' || url || ') and ![' || cast(page_id as string) || '](' || url || ')  raw ' || url
 || chr(10) || chr(10) || chr(10) || chr(10) || 'end ![](https://example.com/a.png) ' || html"""


@query("strip_urls", f"SELECT page_id, {C.sql_strip_urls('t')} AS text FROM (SELECT page_id, {LINKED} AS t FROM pages)")
def strip_urls(t: Tables):
    return t.pages.select("page_id", X.strip_urls(F.expr(LINKED)).alias("text"))


MESSY = """'# T' || chr(10) || '![a](/img/' || cast(doc_id as string) || '.png)' || chr(10) || '!Leftover alt' || chr(10)
 || cast(doc_id % 90 as string) || ' min read' || chr(10) || 'Loading...  ' || chr(10) || '```' || chr(10)
 || '  [link](/x?' || source || ') then [site](https://example.com/' || lang || ')  ' || chr(10) || text || chr(10) || '  '"""


@query("clean_text", f"SELECT doc_id, {C.sql_clean_text('t')} AS text FROM (SELECT doc_id, {MESSY} AS t FROM documents)")
def clean_text(t: Tables):
    return t.documents.select("doc_id", X.clean_text(F.expr(MESSY)).alias("text"))


SCRIPTED = """'<html><body><p>x</p><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":' || props
 || ',"blogData":{"updated_at":"' || substr(cast(ts as string), 1, 10) || 'T10:00:00"}}}}</script><script>var a = 1;</script></body>'"""


@query("embedded_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS updated_at FROM events""")
def embedded_json(t: Tables):
    html = F.expr(SCRIPTED)
    return t.events.select(
        "event_id",
        F.get_json_object(S.embedded_json(html), "$.props.pageProps.data.k").cast("bigint").alias("k"),
        S.updated_at(html).alias("updated_at"))


@query("trim_all", """
SELECT o_orderkey, c_name AS name, o_orderpriority AS priority, c_mktsegment AS segment, o_orderstatus AS status
FROM orders JOIN customer ON o_custkey = c_custkey""")
def trim_all(t: Tables):
    pad = lambda c: F.concat(F.lit("  \t"), c, F.lit(" \n "))
    nested = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.struct(pad(F.col("c_name")).alias("name"),
                 F.array(F.struct(pad(F.col("o_orderpriority")).alias("p"))).alias("items"),
                 F.create_map(F.lit("k"), pad(F.col("c_mktsegment"))).alias("m"),
                 F.array(pad(F.col("o_orderstatus"))).alias("a"),
                 F.lit(1).alias("n")).alias("o"))
    o = S.trim_all(F.col("o"), nested.schema["o"].dataType)
    return nested.select("o_orderkey", o.alias("o")).select(
        "o_orderkey", F.col("o.name").alias("name"), F.col("o.items")[0]["p"].alias("priority"),
        F.col("o.m")["k"].alias("segment"), F.col("o.a")[0].alias("status"))


@query("utc_to_local_date", """
SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS local_date FROM events""")
def utc_to_local_date(t: Tables):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return t.events.select("event_id", S.utc_to_local_date(stamp).alias("local_date"))


@query("compose_duration", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 nullif(concat_ws(' ', CASE WHEN y <> 0 THEN y || ' years' END, CASE WHEN m <> 0 THEN m || ' months' END,
                  CASE WHEN d <> 0 THEN d || ' days' END), '') AS duration
FROM (SELECT *, l_linenumber % 3 AS y, CAST(nullif(l_quantity, 7) AS INTEGER) % 4 AS m, CAST(l_partkey % 2 AS INTEGER) AS d
      FROM lineitem)""")
def compose_duration(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.compose_duration(F.col("l_linenumber") % 3,
                           F.nullif(F.col("l_quantity"), F.lit(7.0)).cast("int") % 4,
                           (F.col("l_partkey") % 2).cast("int")).alias("duration"))


SHOWN_NUMBER = """CASE l_linenumber % 4 WHEN 0 THEN '+' || cast(l_discount as string) || '%'
 WHEN 1 THEN '₹' || cast(cast(l_quantity as bigint) as string) || ',500' WHEN 2 THEN '--' ELSE 'n/a ' || l_returnflag END"""


@query("parse_number", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE l_linenumber % 4 WHEN 0 THEN l_discount WHEN 1 THEN l_quantity * 1000 + 500 END AS number FROM lineitem""")
def parse_number(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             S.parse_number(F.expr(SHOWN_NUMBER)).alias("number"))


@query("null_markers", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS value FROM orders""")
def null_markers(t: Tables):
    cell = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '--' WHEN 1 THEN '' ELSE o_orderpriority END")
    return t.orders.select("o_orderkey", S.null_markers(cell).alias("value"))


@query("format_currency", """
SELECT o_orderkey, '₹' || format('{:,.0f}', o_totalprice) AS whole, '₹' || format('{:,.2f}', o_totalprice) || ' Cr' AS crores,
 '₹' || format('{:,}', o_orderkey) AS plain FROM orders""")
def format_currency(t: Tables):
    return t.orders.select(
        "o_orderkey", S.format_currency(F.col("o_totalprice")).alias("whole"),
        S.format_currency(F.col("o_totalprice"), 2, " Cr").alias("crores"),
        S.rupees(F.col("o_orderkey"), T.LongType()).alias("plain"))


@query("stable_id", """
SELECT doc_id, substr(sha1(concat_ws('|', 'https://example.com/' || source, lang, text, doc_id % 3)), 1, 16) AS id
FROM documents""")
def stable_id(t: Tables):
    return t.documents.select("doc_id", S.stable_id(
        F.concat(F.lit("https://example.com/"), F.col("source")), F.col("lang"), F.col("text"),
        F.col("doc_id") % 3).alias("id"))


@query("url_keys", r"""
SELECT page_id, replace(replace(regexp_replace(url, '^[a-zA-Z]+://[^/]+/?', ''), 'en/', 'e/'), '/', '__') AS key,
 regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host, split_part(url, '/', 4) AS topic,
 left(replace(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '([^/]*)/*$', 1), '-', ' '), 48) AS slug
FROM pages""")
def url_keys(t: Tables):
    url = F.col("url")
    return t.pages.select("page_id", S.raw_key(url, "en/", "e/").alias("key"), S.url_host(url).alias("host"),
                          F.split_part(url, F.lit("/"), F.lit(4)).alias("topic"), S.url_slug(url).alias("slug"))


@query("text_length", f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST({C.sql_tokens('text')} AS BIGINT) AS tokens FROM documents""")
def text_length(t: Tables):
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("chars"),
                              X.token_count(F.col("text")).cast("bigint").alias("tokens"))


@query("tokenize_terms", f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(x) AS BIGINT) AS n_terms, md5(array_to_string(x, ' ')) AS terms_md5,
 CAST(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda s: s <> '')) AS BIGINT) AS n_split
FROM (SELECT doc_id, text, {C.sql_words('text')} AS w, {C.sql_terms('text')} AS x FROM documents)""")
def tokenize_terms(t: Tables):
    terms = X.tokenize_terms(F.col("text"))
    return t.documents.select(
        "doc_id", F.size(X.tokenize_terms(F.col("text"), [])).cast("bigint").alias("n_words"),
        F.size(terms).cast("bigint").alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("terms_md5"),
        F.size(X.split_tokens(F.col("text"))).cast("bigint").alias("n_split"))


ALIASES = {"ring": "loop band", "small": "little", "loop": "hoop", "red": "scarlet"}


@query("canonicalize_alias", """
SELECT p_partkey, replace(replace(replace(replace(lower(upper(p_name)), 'ring', 'loop band'), 'small', 'little'),
 'loop', 'hoop'), 'red', 'scarlet') AS name FROM part""")
def canonicalize_alias(t: Tables):
    return t.part.select("p_partkey", X.canonicalize_alias(F.upper("p_name"), ALIASES).alias("name"))


@query("label_map", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS label,
 CASE WHEN lang = source OR doc_id % 2 = 0 THEN source ELSE source || ' > ' || lang END
  || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' > ' || CAST(doc_id AS VARCHAR) END AS path FROM documents""")
def label_map(t: Tables):
    parent = F.expr("CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END")
    own = F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE cast(doc_id as string) END")
    return t.documents.select(
        "doc_id", S.label_map(F.col("lang"), {"en": "English", "fr": "French"}).alias("label"),
        S.heading_path(F.col("source"), parent, own).alias("path"))


@query("split_sentences", f"""
SELECT k AS turn_key, CAST(len(s) AS BIGINT) AS n, array_to_string(s, chr(3)) AS sentences
FROM (SELECT conv_id * 100 + turn AS k, {C.sql_sentences('t')} AS s FROM
      (SELECT conv_id, turn, {C.ANSWER} AS t FROM conversations))""")
def split_sentences(t: Tables):
    found = X.split_sentences(F.expr(C.ANSWER))
    return t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_key"),
                                  F.size(found).cast("bigint").alias("n"),
                                  F.array_join(found, "\x03").alias("sentences"))


@query("limit_sentences", f"""
SELECT conv_id, turn, {C.sql_limit('s')} AS text FROM (SELECT conv_id, turn, {C.sql_sentences('t')} AS s FROM
 (SELECT conv_id, turn, {C.ANSWER} AS t FROM conversations))""")
def limit_sentences(t: Tables):
    return t.conversations.select("conv_id", "turn", X.limit_sentences(F.expr(C.ANSWER)).alias("text"))


SAFE_TEXT, SAFE_URL = "I can only share facts, not recommendations or comparisons.", "https://example.com/guide"


@query("finalize_answer", f"""
WITH a AS (SELECT conv_id, turn, body, {C.sql_advice('body')} AS blocked, 'https://example.com/' || conv_id AS url,
  CASE WHEN turn % 2 = 0 THEN '2026-01-0' || (1 + conv_id % 9) END AS d FROM
  (SELECT conv_id, turn, {C.SHORT_ANSWER} AS body FROM conversations
   UNION ALL SELECT conv_id, turn + 1000, {C.ANSWER} FROM conversations)),
 b AS (SELECT *, CASE WHEN blocked THEN {C.lit(SAFE_TEXT)} ELSE body END AS shown FROM a),
 s AS (SELECT *, {C.sql_sentences(C.sql_strip_links('shown'))} AS s FROM b),
 l AS (SELECT *, {C.sql_limit('s')} AS out_body FROM s)
SELECT conv_id, turn, blocked, out_body AS body, out_body || chr(10) || chr(10) || 'Source: '
 || CASE WHEN blocked THEN '{SAFE_URL}' ELSE url END
 || CASE WHEN d IS NOT NULL AND NOT blocked THEN chr(10) || 'Last updated from sources: ' || d ELSE '' END AS text FROM l""")
def finalize_answer(t: Tables):
    c = t.conversations
    bodies = c.select("conv_id", "turn", F.expr(C.SHORT_ANSWER).alias("body")).unionAll(
        c.select("conv_id", (F.col("turn") + 1000).alias("turn"), F.expr(C.ANSWER).alias("body")))
    out = G.finalize_answer(
        F.col("body"), F.concat(F.lit("https://example.com/"), F.col("conv_id").cast("string")),
        F.expr("CASE WHEN turn % 2 = 0 THEN '2026-01-0' || cast(1 + conv_id % 9 as string) END"), SAFE_TEXT, SAFE_URL)
    return bodies.select("conv_id", "turn", out.alias("o")).select("conv_id", "turn", "o.blocked", "o.body", "o.text")


@query("extract_numbers", r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '\d[\d,]*(?:\.\d+)?'),
 lambda n: regexp_replace(replace(n, ',', ''), '\.+$', '')))), ' ') AS numbers
FROM (SELECT doc_id, text || ' costs ₹1,47,404.50 or 0.65% of ' || n_chars || ', 3 pm' AS t FROM documents)""")
def extract_numbers(t: Tables):
    priced = F.concat(F.col("text"), F.lit(" costs ₹1,47,404.50 or 0.65% of "), F.col("n_chars").cast("string"),
                      F.lit(", 3 pm"))
    return t.documents.select("doc_id", F.array_join(F.array_sort(X.extract_numbers(priced)), " ").alias("numbers"))


@query("metadata_filter", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def metadata_filter(t: Tables):
    return lookup.metadata_filter(t.documents, source="src3").select("doc_id", "lang", "n_chars")


@query("point_lookup", """
SELECT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def point_lookup(t: Tables):
    keys = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return lookup.point_lookup(t.part, keys, "p_partkey").select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query("truncate_words", f"""
SELECT doc_id, CASE WHEN len(w) > 60 THEN array_to_string(w[1:60], ' ') || '...' ELSE text END AS text
FROM (SELECT doc_id, text, regexp_split_to_array({C.sql_strip('text')}, '\\s+') AS w FROM documents)""")
def truncate_words(t: Tables):
    return t.documents.select("doc_id", X.truncate_words(F.col("text")).alias("text"))


@query("citation_label", r"""
SELECT p.page_id, CASE WHEN d.doc_id IS NOT NULL THEN 'Site · ' || left(d.text, 60)
 WHEN slug <> '' THEN host || ' › ' || slug ELSE host END AS label
FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host,
  left(replace(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '([^/]*)/*$', 1), '-', ' '), 48) AS slug
  FROM pages) p LEFT JOIN (SELECT doc_id, text FROM documents JOIN labels USING (doc_id)) d ON p.page_id = d.doc_id""")
def citation_label(t: Tables):
    # labels know some of the documents, as a source table knows some of the links
    titles = t.documents.join(t.labels, "doc_id", "left_semi").select(
        F.col("doc_id").alias("page_id"), F.col("text").alias("title"))
    return t.pages.select("page_id", "url").join(titles, "page_id", "left").select(
        "page_id", S.citation_label(F.col("url"), F.col("title"), "Site").alias("label"))


@query("pii_types", f"""
SELECT conv_id, turn, array_to_string({C.sql_pii('m')}, ', ') AS kinds FROM (SELECT conv_id, turn, {C.MESSAGE} AS m FROM conversations)
UNION ALL SELECT doc_id, -1, array_to_string({C.sql_pii('text')}, ', ') FROM documents""")
def pii_types(t: Tables):
    messages = t.conversations.select("conv_id", "turn", F.expr(C.MESSAGE).alias("m"))
    texts = t.documents.select("doc_id", F.lit(-1).cast("bigint"), "text")
    return messages.unionAll(texts).select("conv_id", "turn", F.array_join(G.pii_types(F.col("m")), ", ").alias("kinds"))


@query("pii_placeholder", f"""
SELECT conv_id, turn, CASE WHEN len({C.sql_pii('m')}) > 0 THEN {C.lit(P.PII_PLACEHOLDER)} ELSE m END AS shown
FROM (SELECT conv_id, turn, {C.MESSAGE} AS m FROM conversations)""")
def pii_placeholder(t: Tables):
    return t.conversations.select("conv_id", "turn", G.pii_placeholder(F.expr(C.MESSAGE)).alias("shown"))


@query("luhn_cards", f"""
SELECT conv_id, turn, {C.sql_has_card('m')} AS card FROM (SELECT conv_id, turn, {C.MESSAGE} AS m FROM conversations)
UNION ALL SELECT doc_id, -1, {C.sql_has_card('text')} FROM documents""")
def luhn_cards(t: Tables):
    messages = t.conversations.select("conv_id", "turn", F.expr(C.MESSAGE).alias("m"))
    texts = t.documents.select("doc_id", F.lit(-1).cast("bigint"), "text")
    return messages.unionAll(texts).select("conv_id", "turn", G.has_card(F.col("m")).alias("card"))


@query("refusal_kind", f"""
SELECT conv_id, turn, {C.sql_refusal('m')} AS refusal FROM (SELECT conv_id, turn, {C.MESSAGE} AS m FROM conversations)""")
def refusal_kind(t: Tables):
    return t.conversations.select("conv_id", "turn", G.refusal_kind(F.expr(C.MESSAGE), ["acme"]).alias("refusal"))


@query("gives_advice", f"SELECT conv_id, turn, {C.sql_advice('m')} AS advice FROM (SELECT conv_id, turn, {C.ANSWER} AS m FROM conversations)")
def gives_advice(t: Tables):
    return t.conversations.select("conv_id", "turn", G.gives_advice(F.expr(C.ANSWER)).alias("advice"))


SQL_GATE = C.lit(rf"(?i)\?[^\n]*[^\s][^\n]*\?|(?:^|{C.NW})(and|also|plus|as well as)(?:$|{C.NW})|;")


@query("multi_part_gate", f"""
SELECT conv_id, turn, regexp_matches(m, {SQL_GATE}) AS multi FROM (SELECT conv_id, turn, {C.MESSAGE} AS m FROM conversations)""")
def multi_part_gate(t: Tables):
    return t.conversations.select("conv_id", "turn", G.multi_part_gate(F.expr(C.MESSAGE)).alias("multi"))


SQL_OLD_PII = C.lit(
    rf"(?i)(?:^|{C.NW})(?:[A-Z]{{5}}[0-9]{{4}}[A-Z]|[2-9][0-9]{{3}}\s[0-9]{{4}}\s[0-9]{{4}}|[2-9][0-9]{{11}}|\d{{10}}"
    rf"|[0]?(91)?[789]\d{{9}}|\d{{9,18}}|\d{{4,6}})(?:$|{C.NW})"
    rf"|{C.W}[\p{{L}}\p{{N}}_.-]*@[\p{{L}}\p{{N}}_.-]+\.{C.W}|{C.W}\+91[\-\s]?[0]?(91)?[789]\d{{9}}(?:$|{C.NW})")


@query("screen_comparison", f"""
SELECT old, new, count(*) AS n FROM (SELECT regexp_matches(m, {SQL_OLD_PII}) AS old, len({C.sql_pii('m')}) > 0 AS new FROM
 (SELECT {C.MESSAGE} AS m FROM conversations UNION ALL SELECT text FROM documents)) GROUP BY old, new""")
def screen_comparison(t: Tables):
    m = t.conversations.select(F.expr(C.MESSAGE).alias("m")).unionAll(t.documents.select("text"))
    return m.select(G.has_old_pii(F.col("m")).alias("old"), G.has_pii(F.col("m")).alias("new")).groupBy(
        "old", "new").agg(F.count("*").alias("n"))
