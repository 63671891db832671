"""Row-generating operators over composed Markdown and raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.operators import dedupe, sections as E
from corpusmill.plans import compose as C
from corpusmill.plans.registry import Tables, query


def md():
    return F.expr(C.MARKDOWN)


# Lines of the composed Markdown with their running section number.
SQL_SECTIONS = f"""WITH md AS (SELECT doc_id, {C.MARKDOWN} AS m FROM documents),
 ln AS (SELECT doc_id, unnest(string_split(m, chr(10))) AS line, generate_subscripts(string_split(m, chr(10)), 1) AS pos FROM md),
 sec AS (SELECT *, CAST(sum(CASE WHEN line LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS sid FROM ln),
 secs AS (SELECT doc_id, sid AS section_id, len(regexp_extract(first(line ORDER BY pos), '^#{{1,6}}')) AS level,
   {C.sql_strip("regexp_replace(first(line ORDER BY pos), '^#{1,6}', '')")} AS heading,
   {C.sql_strip("array_to_string(list(line ORDER BY pos)[2:], chr(10))")} AS body FROM sec WHERE sid > 0 GROUP BY doc_id, sid)
"""


@query("split_sections", SQL_SECTIONS + "SELECT doc_id, section_id, level, heading, body FROM secs")
def split_sections(t: Tables):
    s = E.explode_sections(t.documents, "doc_id", md())
    return s.select("doc_id", F.col("section_id").cast("bigint").alias("section_id"),
                    F.col("level").cast("bigint").alias("level"), "heading", "body")


@query("section_id", SQL_SECTIONS + """
SELECT doc_id, sid AS section_id, count(*) AS n_lines, CAST(min(pos) AS BIGINT) AS first_line FROM sec GROUP BY doc_id, sid""")
def section_id(t: Tables):
    return E.section_ids(t.documents, "doc_id", md()).groupBy("doc_id", "section_id").agg(
        F.count("*").alias("n_lines"), (F.min("pos") + 1).cast("bigint").alias("first_line"))


@query("parent_heading", SQL_SECTIONS + """, p AS (SELECT *, last_value(CASE WHEN level <= 2 THEN heading END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY section_id ROWS UNBOUNDED PRECEDING) AS top FROM secs)
SELECT doc_id, section_id, heading, CASE WHEN level > 2 THEN top END AS parent_heading,
 coalesce(lower(top) IN ('faqs', 'frequently asked questions'), false) AND level > 2 AS is_faq FROM p""")
def parent_heading(t: Tables):
    return E.parent_headings(t.documents, "doc_id", md()).select(
        "doc_id", F.col("section_id").cast("bigint").alias("section_id"), "heading", "parent_heading", "is_faq")


@query("extract_faqs", rf"""
SELECT doc_id, 1 AS faq_no, 'What is ' || lang || '?' AS question, 'It is' || chr(10) || source || '.' AS answer FROM documents
UNION ALL SELECT doc_id, 2, 'How long is it?', {C.sql_strip(r"regexp_replace(text, '\s*\n\s*', chr(10), 'g')")} FROM documents
 WHERE {C.sql_strip('text')} <> ''""")
def extract_faqs(t: Tables):
    return t.documents.select("doc_id", F.posexplode(E.extract_faqs(md())).alias("pos", "f")).select(
        "doc_id", (F.col("pos") + 1).alias("faq_no"), "f.question", "f.answer")


@query("unpivot_table", """
SELECT doc_id, source AS category, 'Annualised returns' AS active_type, 2 AS n_types, metric, period, value FROM documents,
LATERAL (VALUES ('Fund returns', '1Y', '+' || (n_chars % 50) || '.5%'), ('Fund returns', '3Y', NULL), ('Fund returns', 'All', '+7.7%'),
 ('Rank', '1Y', CAST(doc_id % 9 AS VARCHAR)), ('Rank', '3Y', NULL), ('Rank', 'All', NULL)) v(metric, period, value)""")
def unpivot_table(t: Tables):
    body = t.documents.select("doc_id", E.table_body(md()).alias("b"))
    found = body.select("doc_id", E.context_of(F.col("b")).alias("x"), E.unpivot_body(F.col("b")).alias("u"))
    return found.select("doc_id", "x.category", "x.active_type", F.size("x.available_types").alias("n_types"),
                        F.explode("u").alias("r")).select("doc_id", "category", "active_type", "n_types", "r.*")


@query("pipe_rows", """
SELECT doc_id, row_no, name, sector, instrument, assets, CAST(doc_id % 4 AS INTEGER) AS reported, 2 AS extracted FROM documents,
LATERAL (VALUES (1, 'Co A', lang, 'Equity', '7.5%'), (2, 'Co B', source, 'Debt', (n_chars % 10) || '%')) v(row_no, name, sector, instrument, assets)""")
def pipe_rows(t: Tables):
    rows = t.documents.select("doc_id", E.reported_count(md()).alias("reported"), E.pipe_rows(md()).alias("r"))
    return rows.select("doc_id", "reported", F.size("r").alias("extracted"), F.posexplode("r").alias("p", "c")).select(
        "doc_id", (F.col("p") + 1).alias("row_no"), F.col("c")[0].alias("name"), F.col("c")[1].alias("sector"),
        F.col("c")[2].alias("instrument"), F.col("c")[3].alias("assets"), "reported", "extracted")


@query("key_value_rows", """
SELECT doc_id, '₹' || n_chars AS min_first, '₹1,000' AS min_sip, CAST(doc_id % 5 AS VARCHAR) AS rating, 'tail' AS about FROM documents""")
def key_value_rows(t: Tables):
    # labels become columns inside the row: a pivot by key would shuffle every pair for nothing
    found = t.documents.select("doc_id", md().alias("m")).select(
        "doc_id", E.value_under(F.col("m"), "Rating").alias("rating"), E.section_parts(F.col("m")).alias("parts"))
    told = found.select(
        "doc_id", "rating", E.heading_body(F.col("parts"), "About").alias("about"),
        F.map_from_entries(E.key_values(E.heading_body(F.col("parts"), "Minimum amounts"))).alias("pairs"))
    return told.select(
        "doc_id", F.try_element_at("pairs", F.lit("Min. first")).alias("min_first"),
        F.try_element_at("pairs", F.lit("Min. SIP")).alias("min_sip"), "rating", "about")


@query("profile_blocks", """
SELECT doc_id, 1 AS block_no, 'Raj ' || source AS name, 'Oct 2023 - Present' AS tenure, 'MBA ' || lang || ' CFA' AS education,
 'Prior to this ' || source AS experience FROM documents
UNION ALL SELECT doc_id, 2, 'Ann ' || lang, 'Jan 2020 - Present', 'BCom', NULL FROM documents""")
def profile_blocks(t: Tables):
    return t.documents.select("doc_id", F.posexplode(E.profile_blocks(md())).alias("pos", "p")).select(
        "doc_id", (F.col("pos") + 1).alias("block_no"), "p.name", "p.tenure", "p.education", "p.experience")


SQL_HELP = f"""WITH h AS (SELECT doc_id, text, source, doc_id % 11 AS k,
  {C.sql_clean_text("chr(10) || '![i](/a.png)' || chr(10) || text || chr(10) || '[here](https://example.com/h) ' || chr(10)")} AS a FROM documents),
 art AS (SELECT doc_id, 'How to redeem ' || source || '?' AS question, a AS answer,
   CASE WHEN k IN (0, 1, 3) THEN 'dead page' WHEN k = 2 THEN 'failed' ELSE 'ok' END AS status FROM h)"""


@query("article_records", SQL_HELP + f""",
 b AS (SELECT doc_id, lang, source, {C.sql_clean_text('text')} AS body,
   {C.sql_clean_text("'5 min read' || chr(10) || text || chr(10)")} AS lead FROM documents)
SELECT doc_id, 'help_faq' AS doc_type, question AS title, answer AS text, NULL AS page_title, NULL AS parent_heading FROM art WHERE status = 'ok'
UNION ALL SELECT doc_id, 'blog_section', 'What are ' || source || ' funds', lead, 'What are **' || source || '** funds', NULL FROM b WHERE lead <> ''
UNION ALL SELECT doc_id, 'blog_section', 'Types of ' || lang, 'body one', 'What are **' || source || '** funds', NULL FROM b
UNION ALL SELECT doc_id, 'blog_section', 'Deep ' || source, body, 'What are **' || source || '** funds', 'Types of ' || lang FROM b WHERE body <> ''
UNION ALL SELECT doc_id, 'blog_faq', 'Is ' || lang || ' safe?', 'Yes.', 'What are **' || source || '** funds', 'FAQs' FROM b""")
def article_records(t: Tables):
    # A filter on the article would be moved below it and build it a second time.
    page = F.array(E.help_article(F.expr(C.HELP_PAGE)))
    helps = t.documents.select("doc_id", F.explode(F.filter(page, lambda a: a["status"] == "ok")).alias("a")).select(
        "doc_id", F.lit("help_faq").alias("doc_type"), F.col("a.question").alias("title"), F.col("a.answer").alias("text"),
        F.lit(None).cast("string").alias("page_title"), F.lit(None).cast("string").alias("parent_heading"))
    posts = t.documents.select("doc_id", E.blog_article(F.expr(C.BLOG_PAGE)).alias("a")).select(
        "doc_id", F.col("a.title").alias("page_title"), F.explode("a.sections").alias("s")).select(
        "doc_id", F.when(F.col("s.is_faq"), "blog_faq").otherwise("blog_section").alias("doc_type"),
        F.col("s.heading").alias("title"), F.col("s.text").alias("text"), "page_title",
        F.col("s.parent").alias("parent_heading"))
    return helps.unionByName(posts)


@query("dead_page_filter", SQL_HELP + """,
 ok AS (SELECT doc_id, row_number() OVER (PARTITION BY lower(question), lower(left(answer, 200)) ORDER BY doc_id) AS rn
        FROM art WHERE status = 'ok')
SELECT art.doc_id, CASE WHEN ok.rn > 1 THEN 'duplicate' ELSE status END AS status FROM art LEFT JOIN ok USING (doc_id)""")
def dead_page_filter(t: Tables):
    art = t.documents.select("doc_id", E.help_article(F.expr(C.HELP_PAGE)).alias("a")).select(
        "doc_id", "a.question", "a.answer", "a.status")
    return dedupe.flag_duplicates(
        art, [F.lower("question"), F.lower(F.left("answer", F.lit(200)))], "doc_id", F.col("status") == "ok").select(
        "doc_id", F.when(F.col("duplicate"), "duplicate").otherwise(F.col("status")).alias("status"))


@query("regex_fields", r"""
SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, nullif(regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1), '') AS lang,
 trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\s+', ' ', 'g')) AS name,
 array_to_string(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"', 1), ' ') AS links,
 '01 Jan ''26' AS nav_date, page_id + 0.5 AS nav, CASE WHEN page_id % 2 = 0 THEN 1.25 END AS sharpe_ratio, CAST(NULL AS DOUBLE) AS beta FROM pages""")
def regex_fields(t: Tables):
    html = F.col("html")
    stats = F.expr("""'NAV: 01 Jan ''26 ₹' || cast(page_id as string) || '.50 "sharpe_ratio":'
      || CASE WHEN page_id % 2 = 0 THEN '1.25' ELSE 'null' END || ',' """)
    page = E.regex_fields(html, {
        "title": (r"(?is)<title>(.*?)</title>", 1, "text"), "lang": (r'(?i)<html[^>]*lang="([^"]*)"', 1, "nonempty"),
        "name": (r"(?is)<h1[^>]*>(.*?)</h1>", 1, "line"), "links": (r'(?is)<a[^>]*href="([^"]*)"', 1, "all")})
    nav = r"(?i)NAV:\s*(.*?)\s*₹([\d.,]+)"
    figures = E.regex_fields(stats, {
        "nav_date": (nav, 1, "text"), "nav": (nav, 2, "number"), "sharpe_ratio": (r'"sharpe_ratio":(null|[-\d\.eE]+)', 1, "number"),
        "beta": (r'"beta":(null|[-\d\.eE]+)', 1, "number")})
    return t.pages.select("page_id", page.alias("p"), figures.alias("f")).select(
        "page_id", "p.title", "p.lang", "p.name", F.array_join("p.links", " ").alias("links"), "f.*")
