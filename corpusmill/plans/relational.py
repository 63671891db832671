"""Joins, aggregates, windows, top-k, sets and file sources over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import scalars as S
from corpusmill.functions import text as X
from corpusmill.operators import dedupe, facts, lookup, publish, relational as R
from corpusmill.operators.buckets import BUCKET, BucketBuild
from corpusmill.operators.keyed import KeyedTable
from corpusmill.plans import compose as C
from corpusmill.plans import facts as PF
from corpusmill.plans.registry import Tables, query
from corpusmill.session import scratch_path
from corpusmill.sources import files


@query("fact_dim_join", """
SELECT l_orderkey, l_linenumber, l_suppkey, p_name, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')""")
def fact_dim_join(t: Tables):
    keys = t.part.where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("l_partkey"))
    dim = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return R.fact_dim_join(t.lineitem, dim, "l_partkey", keys).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "p_name", "l_discount")


@query("provenance_join", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def provenance_join(t: Tables):
    return R.provenance_join(t.documents.select("doc_id", "lang"), t.labels, "doc_id", ["quality", "toxic"])


@query("missing_reference", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_reference(t: Tables):
    return R.missing_reference(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("tolerance_check", """
SELECT o_orderkey, round(o_totalprice, 2) AS page_value, json_value FROM orders JOIN
 (SELECT l_orderkey AS o_orderkey, round(sum(l_extendedprice), 2) AS json_value FROM lineitem GROUP BY 1) USING (o_orderkey)
WHERE abs(o_totalprice - json_value) > 0.1""")
def tolerance_check(t: Tables):
    page = t.orders.select("o_orderkey", F.round("o_totalprice", 2).alias("page_value"))
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("json_value"))
    return facts.tolerance_check(page, sums, ["o_orderkey"], "page_value", "json_value")


SCOPE_IDS = "CASE item_id % 4 WHEN 0 THEN array('en') WHEN 1 THEN array('de', 'fr') WHEN 2 THEN array('xx') ELSE filter(array('en'), x -> false) END"


@query("scope_join", """
SELECT item_id, count(*) AS n_visible, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM benchmark JOIN documents ON item_id % 4 = 3 OR lang = 'es' OR (item_id % 4 = 0 AND lang = 'en') OR (item_id % 4 = 1 AND lang IN ('de', 'fr'))
GROUP BY item_id""")
def scope_join(t: Tables):
    chunks = t.documents.select("doc_id", F.nullif(F.col("lang"), F.lit("es")).alias("scope"))
    return R.scope_join(t.benchmark.select("item_id", F.expr(SCOPE_IDS).alias("ids")), chunks, "item_id", "ids", "scope", {
        "n_visible": (F.count, F.sum, F.lit(1)), "first_doc": (F.min, F.min, F.col("doc_id")),
        "last_doc": (F.max, F.max, F.col("doc_id"))})


@query("in_list_filter", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def in_list_filter(t: Tables):
    keys = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return lookup.in_list_filter(t.orders, keys, "o_custkey").select("o_orderkey", "o_totalprice")


@query("pattern_label", rf"""
SELECT d.doc_id, b.item_id, regexp_matches(h, '(?i)' || p) AS relevant,
 regexp_matches(h, '(?i)' || p) AND regexp_matches(h, '(?i)the|de|la') AS all_match
FROM (SELECT doc_id, source || ' || ' || left(regexp_replace(text, '^[^\n]*\n', ''), 300) AS h FROM documents) d
JOIN (SELECT item_id, regexp_extract(lower(text), '\p{{L}}+', 0) || '.*(and|et|und)' AS p FROM benchmark) b
 ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id""")
def pattern_label(t: Tables):
    n = t.benchmark.agg(F.count("*").alias("n"))
    head = F.concat(F.col("source"), F.lit(" || "), F.left(X.rep(F.col("text"), r"\A[^\n]*\n"), F.lit(300)))
    hits = t.documents.select("doc_id", (F.col("doc_id") % n.scalar()).alias("item_id"), head.alias("h"))
    wanted = t.benchmark.select("item_id", F.concat(F.regexp_extract(F.lower("text"), r"\p{L}+", 0), F.lit(".*(and|et|und)")).alias("p"))
    return R.pattern_label(hits, wanted, "item_id", F.col("h"), "p").select(
        "doc_id", "item_id", "relevant", R.all_patterns(F.col("h"), F.array("p", F.lit("the|de|la"))).alias("all_match"))


@query("attach_vectors", """
SELECT coalesce(doc_id, vec_id) AS id, lang, label, CAST(len(embedding) AS INTEGER) AS dims,
 CASE WHEN vec_id IS NULL THEN 'no vector' WHEN doc_id IS NULL THEN 'no text' ELSE 'ok' END AS status
FROM documents FULL JOIN embeddings ON doc_id = vec_id""")
def attach_vectors(t: Tables):
    chunks = t.documents.select(F.col("doc_id").alias("id"), "lang")
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "label", F.size("embedding").alias("dims"))
    return R.attach_vectors(chunks, vectors, "id")


# ---- aggregates ----

@query("count_by", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC")
def count_by(t: Tables):
    return R.count_by(t.documents, "lang", "source").orderBy(F.desc("n"), "lang", "source")


@query("size_stats_by", """
SELECT lang, count(*) AS n, CAST(min(length(text)) AS BIGINT) AS min_size, CAST(floor(avg(length(text))) AS BIGINT) AS avg_size,
 CAST(max(length(text)) AS BIGINT) AS max_size FROM documents GROUP BY lang""")
def size_stats_by(t: Tables):
    return R.size_stats_by(t.documents, "lang", F.length("text"))


@query("distribution_stats", """
WITH v AS (SELECT n_chars AS v FROM documents), s AS (SELECT source FROM documents GROUP BY source HAVING count(*) > 1)
SELECT count(*) AS n, min(v) AS min, max(v) AS max, CAST(sum(v) AS BIGINT) AS total, round(sum(v) / 1e6 * 0.02, 6) AS cost, round(avg(v), 6) AS mean,
 round(stddev(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90,
 round(quantile_cont(v, 0.95), 6) AS p95, (list_sort(list(v)))[count(*) // 2 + 1] AS median, (SELECT count(*) FROM s) AS n_split FROM v""")
def distribution_stats(t: Tables):
    return R.distribution_stats(t.documents, F.col("n_chars"), "source", 0.02)


@query("duplicate_keys", """
SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n > 1""")
def duplicate_keys(t: Tables):
    return R.duplicate_keys(t.orders, "o_custkey")


@query("ordered_string_agg", PF.SQL_FACTS + "SELECT scheme_id, managers AS names FROM mg")
def ordered_string_agg(t: Tables):
    managers = facts.fact_tables(PF.facts_from_part(t))["fund_managers"].withColumn(
        "shown", F.concat("name", F.lit(" (since "), "since", F.lit(")")))
    return R.ordered_string_agg(managers, "scheme_id", "shown", ["since", "name"]).withColumnRenamed("joined", "names")


REASON = "CASE WHEN quality = 0 AND toxic = 1 THEN 'no article found' WHEN toxic = 1 THEN 'dead page' WHEN quality = 0 THEN 'duplicate' END"


@query("failure_rate_gate", f"""
WITH r AS (SELECT {REASON} AS reason FROM labels), c AS (SELECT count(*) AS entries, count_if(reason = 'no article found') AS failures,
 count_if(reason = 'duplicate') AS duplicates, count_if(reason = 'dead page') AS dead FROM r)
SELECT CAST(entries AS BIGINT) AS entries, CAST(failures AS BIGINT) AS failures, CAST(duplicates AS BIGINT) AS duplicates, CAST(dead AS BIGINT) AS dead,
 round(failures / entries, 6) AS rate, failures / entries <= 0.1 AS passed FROM c""")
def failure_rate_gate(t: Tables):
    return R.failure_rate_gate(t.labels, F.expr(REASON))


SQL_ROLLUP = """SELECT 'https://example.com/' || source AS url, arg_min(md5(text), doc_id) AS title,
 CASE arg_min(lang, doc_id) WHEN 'en' THEN 'help_page' ELSE arg_min(lang, doc_id) END AS source_type, count(*) AS documents
FROM documents GROUP BY source"""


def rollup(t: Tables):
    d = t.documents.select(
        F.concat(F.lit("https://example.com/"), F.col("source")).alias("url"), F.md5("text").alias("title"),
        S.label_map(F.col("lang"), {"en": "help_page"}).alias("source_type"), "doc_id")
    return R.source_rollup(d, "url", "doc_id", ["title", "source_type"])


@query("source_rollup", SQL_ROLLUP)
def source_rollup(t: Tables):
    return rollup(t)


@query("freshness", "SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS updated FROM orders GROUP BY o_custkey")
def freshness(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("updated"))


@query("accuracy_by_class", """
WITH r AS (SELECT quality, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS got FROM labels JOIN documents USING (doc_id))
SELECT coalesce(CAST(quality AS VARCHAR), '(all)') AS expected, CAST(sum(CASE WHEN quality = got THEN 1 ELSE 0 END) AS BIGINT) AS correct,
 count(*) AS total, round(sum(CASE WHEN quality = got THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM r GROUP BY ROLLUP (quality)""")
def accuracy_by_class(t: Tables):
    ruled = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "quality", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("got"))
    return R.accuracy_by_class(ruled, "quality", "got")


@query("metric_means", """
SELECT event_type, round(avg(value), 6) AS value, round(avg(CAST(json_extract(props, '$.k') AS BIGINT)), 6) AS k, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'MEAN', round(avg(value), 6), round(avg(CAST(json_extract(props, '$.k') AS BIGINT)), 6), count(*) FROM events""")
def metric_means(t: Tables):
    e = t.events.select("event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return R.metric_means(e, "event_type", "value", "k")


@query("multiset_match", """
WITH g AS (SELECT conv_id, list_sort(list(role)) AS got FROM conversations GROUP BY 1)
SELECT conv_id, got = ['assistant', 'assistant', 'user', 'user'] AS same_multiset, list_sort(list_distinct(got)) = ['assistant', 'user'] AS same_set FROM g""")
def multiset_match(t: Tables):
    ids = t.conversations.select("conv_id").distinct()
    expected = ids.select("conv_id", F.explode(F.array(*[F.lit(x) for x in ("user", "assistant", "user", "assistant")])).alias("role"))
    return R.multiset_match(t.conversations, expected, "conv_id", "role")


# ---- windows ----

@query("occurrence_no", """
SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS occurrence_no FROM documents""")
def occurrence_no(t: Tables):
    return dedupe.occurrence_no(t.documents.select("doc_id", "source", "lang"), ["source", "lang"], "doc_id").select(
        "doc_id", "source", "occurrence_no")


@query("dedupe_first", """
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(left(text, 200)), lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedupe_first(t: Tables):
    return dedupe.dedupe_first(t.documents, [F.lower(F.left("text", F.lit(200))), F.col("lang")], "doc_id").select("doc_id", "source")


@query("last_n_turns", """
WITH p AS (SELECT q.conv_id, q.turn, 'User: ' || q.text || chr(10) || 'Assistant: ' || left(a.text, 300) AS s FROM conversations q
  JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, array_to_string(coalesce(list(s) OVER w, []), chr(10)) AS transcript, CAST(count(s) OVER w AS INTEGER) AS n_turns FROM p
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def last_n_turns(t: Tables):
    return R.last_n_turns(R.turn_pairs(t.conversations)).select("conv_id", "turn", "transcript", "n_turns")


@query("period_ordinal", """
SELECT o_orderkey, ord, value FROM orders, LATERAL (VALUES (0, o_orderstatus), (1, o_orderpriority), (2, CAST(o_custkey AS VARCHAR))) v(ord, value)""")
def period_ordinal(t: Tables):
    return t.orders.select("o_orderkey", F.posexplode(F.array(
        "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))).alias("ord", "value"))


# ---- order and top-k ----

@query("global_order", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")
def global_order(t: Tables):
    return t.part.select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@query("topn_per_group", """
SELECT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, w, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(w, 0) DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate) AS rank
 FROM (SELECT *, CASE WHEN l_quantity > 10 THEN l_extendedprice END AS w FROM lineitem)) WHERE rank <= 5""")
def topn_per_group(t: Tables):
    weighted = t.lineitem.withColumn("w", F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")))
    order = [F.coalesce("w", F.lit(0.0)).desc(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_shipdate")]
    top = R.topn_per_group(weighted.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "w", "l_shipdate"),
                           ["l_orderkey"], order, P.TOP_HOLDINGS_ANSWER)
    return top.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "w", F.col("rank").cast("bigint").alias("rank"))


@query("sort_by_parsed_limit", """
SELECT p_name, l_orderkey, l_linenumber, l_partkey, l_discount || '%' AS weight FROM lineitem JOIN part ON l_partkey = p_partkey
ORDER BY p_name, l_discount DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10""")
def sort_by_parsed_limit(t: Tables):
    shown = R.fact_dim_join(t.lineitem, t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").withColumn(
        "weight", F.concat(F.col("l_discount").cast("string"), F.lit("%")))
    return shown.orderBy("p_name", S.parse_number(F.col("weight")).desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(10).select(
        "p_name", "l_orderkey", "l_linenumber", "l_partkey", "weight")


@query("preview", "SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT count(*) FROM orders) AS row_count FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(t: Tables):
    return R.preview(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 10)


# ---- sets ----

@query("union_documents", """
SELECT 'document' AS kind, doc_id AS id, text, lang, source, NULL AS role FROM documents UNION ALL SELECT 'benchmark', item_id, text, NULL, NULL, NULL FROM benchmark
UNION ALL SELECT 'turn', conv_id, text, NULL, NULL, role FROM conversations""")
def union_documents(t: Tables):
    kind = lambda k: F.lit(k).alias("kind")
    return R.union_documents(
        t.documents.select(kind("document"), F.col("doc_id").alias("id"), "text", "lang", "source"),
        t.benchmark.select(kind("benchmark"), F.col("item_id").alias("id"), "text"),
        t.conversations.select(kind("turn"), F.col("conv_id").alias("id"), "text", "role"))


@query("distinct_sorted", "SELECT DISTINCT url FROM pages ORDER BY url")
def distinct_sorted(t: Tables):
    return t.pages.select("url").distinct().orderBy("url")


SAID = "text || ' pays ' || cast(conv_id % 7 as string) || '.5% and 1,0' || cast(turn as string) || '0 on day ' || cast(turn % 3 as string)"


@query("ungrounded_values", rf"""
WITH n AS (SELECT DISTINCT conv_id, role, regexp_replace(replace(unnest(regexp_extract_all({SAID}, '\d[\d,]*(?:\.\d+)?')), ',', ''), '\.+$', '') AS number FROM conversations)
SELECT conv_id, number FROM n WHERE role = 'assistant' EXCEPT SELECT conv_id, number FROM n WHERE role = 'user'""")
def ungrounded_values(t: Tables):
    said = t.conversations.select("conv_id", "role", F.expr(SAID).alias("t"))
    return R.ungrounded_values(said.where("role = 'assistant'"), said.where("role = 'user'"), "conv_id", "t", "t")


@query("ordered_union_arrays", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(a || list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS ids FROM (SELECT *,
 CASE WHEN l_linenumber = l_suppkey % 7 THEN [l_linenumber] ELSE [l_linenumber, l_suppkey % 7] END AS a,
 CASE WHEN l_suppkey % 7 = l_partkey % 7 THEN [l_suppkey % 7] ELSE [l_suppkey % 7, l_partkey % 7] END AS b FROM lineitem)""")
def ordered_union_arrays(t: Tables):
    a = F.array_distinct(F.array(F.col("l_linenumber").cast("bigint"), F.col("l_suppkey") % 7))
    b = F.array(F.col("l_suppkey") % 7, F.col("l_partkey") % 7)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             F.array_join(F.array_union(a, b), ",").alias("ids"))


@query("unique_texts", """
SELECT conv_id, turn, CASE WHEN a = b AND b = c THEN a WHEN a = b OR b = c OR a = c THEN a || chr(10) || CASE WHEN a = b THEN c ELSE b END ELSE a || chr(10) || b || chr(10) || c END AS texts
FROM (SELECT conv_id, turn, text AS a, CASE WHEN turn % 2 = 0 THEN text ELSE role END AS b, CASE WHEN conv_id % 3 = 0 THEN role ELSE text END AS c FROM conversations)""")
def unique_texts(t: Tables):
    parts = F.expr("array(text, CASE WHEN turn % 2 = 0 THEN text ELSE role END, CASE WHEN conv_id % 3 = 0 THEN role ELSE text END)")
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_distinct(parts), "\n").alias("texts"))


# ---- sources and sinks ----

def event_arrays(t: Tables, *cols: str) -> str:
    """Folder of files with one JSON array of at most 50,000 events each."""
    path = scratch_path(t.spark, "json-array")
    arrays = t.events.groupBy(F.floor(F.col("event_id") / 50_000).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*cols))).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    return path


@query("scan_json_array", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY user_id")
def scan_json_array(t: Tables):
    read = files.scan_json_array(t.spark, event_arrays(t, "event_id", "user_id", "value"), "event_id bigint, user_id bigint, value double")
    return read.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("scan_large_arrays", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY event_type")
def scan_large_arrays(t: Tables):
    """Every file by splits, whatever its size; the events' own JSON texts stand in strings with commas, quotes and braces."""
    path = event_arrays(t, "event_id", "event_type", "value", "props")
    read = files.scan_json_array(t.spark, path, "event_id bigint, event_type string, value double, props string", whole=0)
    return read.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"), F.sum(F.length("props")).alias("chars"))


@query("scan_jsonl", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_jsonl(t: Tables):
    path = scratch_path(t.spark, "jsonl")
    files.sink_jsonl(t.documents, f"{path}/deep/er")
    return files.scan_jsonl(t.spark, path, t.documents.schema, recursive=True)


@query("sink_jsonl", "SELECT item_id, md5(text) AS text_md5 FROM benchmark UNION ALL SELECT doc_id, md5(text) FROM documents")
def sink_jsonl(t: Tables):
    path = scratch_path(t.spark, "sink-jsonl")
    files.sink_jsonl(t.benchmark.unionAll(t.documents.select("doc_id", "text")), path)
    return files.scan_jsonl(t.spark, path, "item_id bigint, text string").select("item_id", F.md5("text").alias("text_md5"))


@query("sink_partitioned", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def sink_partitioned(t: Tables):
    path = scratch_path(t.spark, "sections")
    files.sink_partitioned(t.documents, path, "source")
    back = t.spark.read.schema("doc_id bigint, n_chars bigint, source string").json(path)
    return back.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("scan_whole_text", "SELECT CAST(page_id AS VARCHAR) AS key, md5(html) AS html_md5 FROM pages")
def scan_whole_text(t: Tables):
    path = scratch_path(t.spark, "pages")

    pages = t.pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), "html")
    files.write_files(pages, path, "name", "html")
    return files.scan_whole_text(t.spark, path, ".html").select("key", F.md5("text").alias("html_md5"))


@query("scan_csv_header", "SELECT doc_id, quality, toxic FROM labels")
def scan_csv_header(t: Tables):
    path = scratch_path(t.spark, "csv")
    t.labels.write.option("header", True).csv(path)
    return files.scan_csv(t.spark, path, "doc_id bigint, quality int, toxic int")


@query("sink_csv_sorted", SQL_ROLLUP)
def sink_csv_sorted(t: Tables):
    path = scratch_path(t.spark, "sources-csv")
    files.sink_csv_sorted(rollup(t), path, ["url", "title", "source_type", "documents"], ["source_type", "url"])
    return files.scan_csv(t.spark, path, "url string, title string, source_type string, documents bigint")


@query("sitemap_urls", """
WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href="/([^"\\s<]+)"', 1)) AS u FROM pages)
SELECT 'https://example.com/help/' || u AS url, split_part(u, '/', 1) AS topic FROM u WHERE u <> '' ORDER BY url""")
def sitemap_urls(t: Tables):
    # the page's links as a sitemap, with entries outside the prefix among them
    xml = X.rep(F.col("html"), r'<a href="/([^"\s<]+)"', "<loc> https://example.com/help/$1 </loc><loc>https://other.example/$1</loc><a ")
    return files.sitemap_urls(t.pages, xml, "https://example.com/help/")


@query("upsert_latest", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, src DESC, event_id DESC) AS rn
 FROM (SELECT user_id, event_type, ts, event_id, value, 0 AS src FROM events UNION ALL SELECT user_id, event_type, ts, event_id, value + 1, 1 FROM events WHERE event_type = 'click')) WHERE rn = 1
ORDER BY event_type, user_id""")
def upsert_latest(t: Tables):
    old = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    new = old.where("event_type = 'click'").withColumn("value", F.col("value") + 1)
    return dedupe.upsert_latest(old, new, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "value")


@query("replace_children", """
SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
 UNION ALL SELECT o_orderkey, 1.0 FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 2.0 FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def replace_children(t: Tables):
    old = t.lineitem.select("l_orderkey", "l_quantity")
    fresh = t.orders.where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("l_quantity"))
    return publish.replace_children(old, fresh, "l_orderkey").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("upsert_compacted", """
WITH r AS (SELECT user_id, event_type, ts, event_id, value, event_id % 4 AS batch FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, batch DESC, event_id DESC, value DESC) AS rn FROM r),
d AS (SELECT user_id, event_type, max(ts) AS ts FROM events WHERE user_id % 7 = 0 GROUP BY ALL)
SELECT g.user_id, g.event_type, g.event_id, g.value FROM g ANTI JOIN d ON d.user_id = g.user_id AND d.event_type = g.event_type WHERE rn = 1""")
def upsert_compacted(t: Tables):
    """Events in four batches, one of them twice, compacted in between; every seventh user is deleted after the last event."""
    rows = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    table = KeyedTable(t.spark, scratch_path(t.spark, "keyed"), rows.schema, ["user_id", "event_type"], "ts", buckets=8)
    for batch in (0, 1, 1, 2):
        table.write(rows.where(F.col("event_id") % 4 == batch), batch)
        if batch == 1:
            table.compact()
    table.write(rows.where("event_id % 4 = 3"), 3)
    table.remove(rows.where("user_id % 7 = 0").groupBy("user_id", "event_type").agg(F.max("ts").alias("last")), 4, F.col("last"))
    table.compact()
    return table.read().select("user_id", "event_type", "event_id", "value")


@query("children_compacted", """
SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM (
 SELECT l_orderkey, l_quantity FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('P', 'F')) ON o_orderkey = l_orderkey
 UNION ALL SELECT o_orderkey, unnest([1.0, 2.0]) FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def children_compacted(t: Tables):
    """Items of all orders; then those of orders 'P' are replaced by two each, and those of orders 'F' deleted."""
    items = t.lineitem.select("l_orderkey", "l_quantity").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    table = KeyedTable(t.spark, scratch_path(t.spark, "children"), items.schema, ["l_orderkey"], buckets=8)
    table.write(items, 0)
    table.compact()
    table.write(t.orders.where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("l_quantity")), 1)
    table.remove(t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), 2)
    return table.read().groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("rebuild_changed", """
SELECT 16 AS first_run, 0 AS second_run, 1 AS one_changed, 16 AS other_model, count(*) AS n, CAST(sum(length(text)) + 1 AS BIGINT) AS chars FROM documents""")
def rebuild_changed(t: Tables):
    """Buckets rebuilt at first, without a change, after one text has grown by a character, and for another model; then all rows."""
    index = BucketBuild(t.spark, scratch_path(t.spark, "index"), ["doc_id"], buckets=16)
    sizes = lambda df: df.select("doc_id", F.length("text").alias("chars"), BUCKET)
    least = t.documents.agg(F.min("doc_id")).scalar()
    grown = t.documents.withColumn("text", F.when(F.col("doc_id") == least, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    runs = [index.refresh(df, ["doc_id", "text"], model, sizes) for df, model in (
        (t.documents, "m1"), (t.documents, "m1"), (grown, "m1"), (grown, "m2"))]
    counts = [F.lit(len(r)).alias(n) for r, n in zip(runs, ("first_run", "second_run", "one_changed", "other_model"))]
    return index.read().agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).select(*counts, "n", "chars")


@query("skip_if_unchanged", """
WITH d AS (SELECT sha1(concat_ws(chr(31), 'm1', CAST(doc_id AS VARCHAR), text)) AS h FROM documents)
SELECT count(*) AS n, CAST(sum(CAST(('0x' || left(h, 12)) AS HUGEINT)) AS VARCHAR) AS high, CAST(sum(CAST(('0x' || substr(h, 13, 12)) AS HUGEINT)) AS VARCHAR) AS low,
 false AS first_run, true AS second_run, false AS other_model FROM d""")
def skip_if_unchanged(t: Tables):
    path = scratch_path(t.spark, "index-info")
    fp = publish.content_fingerprint(t.documents, ["doc_id", "text"], "m1")
    runs = [publish.is_up_to_date(t.spark, path, fp, "m1")]
    publish.store_fingerprint(path, fp, "m1")
    runs += [publish.is_up_to_date(t.spark, path, fp, "m1"), publish.is_up_to_date(t.spark, path, fp, "m2")]
    return fp.select("*", *[F.lit(r).alias(n) for r, n in zip(runs, ("first_run", "second_run", "other_model"))])
