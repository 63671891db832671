"""Keyword and vector search, fusion, entities and retrieval quality over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import scalars as S
from corpusmill.functions import text as X
from corpusmill.operators import dense, entities, evaluation, fusion, lexical
from corpusmill.operators import relational as R
from corpusmill.plans import compose as C
from corpusmill.plans.registry import Tables, query

# Entities named in questions: scope key -> aliases, with house names and generic words.
ALIASES = {"en": ["from", "with", "er"], "fr": ["que", "la", "les"], "de": ["der", "ein"]}
HOUSE, GENERIC = ["that"], ["he", "re"]


def chunks(t: Tables):
    """Documents with scope key (Spanish text is visible to all) and a vector dealt to them by id; what is long stays in
    ``documents``, so that no text goes through this join."""
    n = t.embeddings.agg(F.count("*").alias("n"))
    d = t.documents.select(F.col("doc_id").alias("id"), F.nullif(F.col("lang"), F.lit("es")).alias("key"),
                           (F.col("doc_id") % n.scalar()).alias("vec_id"))
    return d.join(t.embeddings.select("vec_id", F.col("embedding").alias("vec"), "label"), "vec_id")


def documents(t: Tables, *more):
    """Documents with terms and scope key; ``more``: further columns."""
    return t.documents.select(F.col("doc_id").alias("id"), F.nullif(F.col("lang"), F.lit("es")).alias("key"),
                              X.tokenize_terms(F.col("text")).alias("terms"), *more)


def questions(t: Tables):
    found = t.benchmark.select(F.col("item_id").alias("qid"), "text",
                               entities.resolve_entities(F.col("text"), ALIASES, HOUSE, GENERIC).alias("e"))
    vecs = t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel"))
    return found.select("qid", "text", F.col("e.ids").alias("scope"), F.col("e.stripped").alias("stripped")).join(vecs, "qid")


def sql_cut(x: str, words: list[str]) -> str:
    step = (f"(?i)(^|{C.NW})(?:{'|'.join(words)})($|{C.NW})", r"\1 \2")
    return C.chain(x, step, step)


def sql_has(x: str, words: list[str]) -> str:
    pattern = C.lit(f"(?i)(?:^|{C.NW})(?:{'|'.join(words)})(?:$|{C.NW})")
    return f"regexp_matches({x}, {pattern})"


_cut = "text"
for _names in ALIASES.values():
    _cut = sql_cut(_cut, _names)
_all = [a for names in ALIASES.values() for a in names] + HOUSE
_bare = f"CASE WHEN {sql_has('text', _all)} THEN {sql_cut(sql_cut(_cut, HOUSE), GENERIC)} ELSE text END"
SQL_ASK = f"""q AS (SELECT item_id AS qid, text, list_filter([{', '.join(f"CASE WHEN {sql_has('text', a)} THEN '{k}' END" for k, a in ALIASES.items())}], lambda k: k IS NOT NULL) AS scope,
  coalesce(nullif({C.sql_strip(f"regexp_replace({_bare}, '\\s+', ' ', 'g')")}, ''), text) AS stripped FROM benchmark)"""

SQL_STATS = f"""tok AS MATERIALIZED (SELECT id, key, term FROM (SELECT doc_id AS id, nullif(lang, 'es') AS key, unnest({C.sql_words('text')}) AS term FROM documents)
   ANTI JOIN (SELECT unnest({C.STOP_LIST}) AS term) USING (term)),
 tf AS MATERIALIZED (SELECT id, key, dl, term, count(*) AS f FROM tok JOIN (SELECT id, count(*) AS dl FROM tok GROUP BY id) USING (id) GROUP BY ALL),
 n AS MATERIALIZED (SELECT n, (SELECT count(*) FROM tok) / n AS avgdl FROM (SELECT count(*) AS n FROM documents)),
 raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n),
 idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, (SELECT avg(raw) AS mean FROM raw))"""


def sql_bm25(name: str, source: str, k: int) -> str:
    """Ranked keyword hits of a query table (qid, terms, scope)."""
    return f"""{name}_t AS (SELECT qid, scope, term, count(*) AS mult FROM (SELECT qid, scope, unnest(terms) AS term FROM {source}) GROUP BY ALL),
 {name}_s AS (SELECT qid, id, round(sum(mult * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM {name}_t JOIN idf USING (term) JOIN tf USING (term), n
   WHERE len(scope) = 0 OR key IS NULL OR list_contains(scope, key) GROUP BY qid, id),
 {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})"""


SQL_VECS = """dv AS (SELECT doc_id AS id, nullif(lang, 'es') AS key, embedding::DOUBLE[] AS v, label FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
 qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qvec, label AS qlabel FROM embeddings)"""


def sql_dense(name: str, source: str, corpus: str, k: int) -> str:
    """Ranked vector hits of a query table (qid, qvec, scope)."""
    return f"""{name} AS (SELECT * FROM (SELECT qid, id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM
 (SELECT qid, id, round(list_dot_product(qvec, v), 9) AS cosine FROM {source}, {corpus} WHERE len(scope) = 0 OR key IS NULL OR list_contains(scope, key))) WHERE rank <= {k})"""


def sql_fuse(name: str, vec: str, kw: str, k: int) -> str:
    return f"""{name}_f AS (SELECT qid, id, d.rank AS dr, b.rank AS br, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(0.25 / (60 + b.rank), 0), 9) AS fused
   FROM (SELECT * FROM {vec} WHERE rank <= 20) d FULL JOIN (SELECT * FROM {kw} WHERE rank <= 20) b USING (qid, id)),
 {name}_p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(dr = 1, false) OR coalesce(br = 1, false) DESC, fused DESC, id) AS p FROM {name}_f),
 {name} AS (SELECT qid, id, fused AS score, dr, br, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) AS rank FROM {name}_p WHERE p <= {k})"""


long = lambda c: F.col(c).cast("bigint").alias(c)


# ---- keyword ----

@query("corpus_stats", f"WITH {SQL_STATS} SELECT term, df, round(idf, 9) AS idf FROM idf")
def corpus_stats(t: Tables):
    return lexical.corpus_stats(lexical.corpus_counts(documents(t))).select("term", "df", F.round("idf", 9).alias("idf"))


@query("bm25_topk", f"""WITH {SQL_STATS}, q AS (SELECT item_id AS qid, {C.sql_terms('text')} AS terms, [] AS scope FROM benchmark),
 {sql_bm25('b', 'q', 20)} SELECT qid, id, score, rank FROM b""")
def bm25_topk(t: Tables):
    q = t.benchmark.select(F.col("item_id").alias("qid"), X.tokenize_terms(F.col("text")).alias("terms"))
    return lexical.bm25_topk(q, documents(t).select("id", "terms"), 20).select("qid", "id", "score", long("rank"))


NAME_TEXT = """'price of the ' || p_type || ' ' || p_name || CASE p_partkey % 9 WHEN 0 THEN ' of all' WHEN 1 THEN ' schemes' ELSE '' END"""


@query("name_match_topk", f"""
WITH dt AS (SELECT id, name, regexp_split_to_array(lower(name), '\\s+') AS terms FROM (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name)),
 tok AS (SELECT id, NULL AS key, len(terms) AS dl, unnest(terms) AS term FROM dt), tf AS (SELECT id, key, dl, term, count(*) AS f FROM tok GROUP BY ALL),
 n AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM dt), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n),
 idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, (SELECT avg(raw) AS mean FROM raw)),
 qq AS (SELECT p_partkey AS qid, {NAME_TEXT} AS text, CASE WHEN p_partkey % 2 = 0 THEN 'NAV' ELSE 'LIST' END AS intent FROM part),
 q AS (SELECT qid, regexp_split_to_array(lower(text), '\\s+') AS terms, [] AS scope FROM qq WHERE NOT (contains(text, 'all') OR contains(text, 'schemes'))),
 {sql_bm25('b', 'q', 3)}
SELECT qid, id, CAST(rank AS INTEGER) AS rank FROM b JOIN qq USING (qid) WHERE rank = 1 OR intent <> 'NAV'
UNION ALL SELECT qid, NULL, 0 FROM qq WHERE contains(text, 'all') OR contains(text, 'schemes')""")
def name_match_topk(t: Tables):
    names = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    q = t.part.select(F.col("p_partkey").alias("qid"), F.expr(NAME_TEXT).alias("text"),
                      F.when(F.col("p_partkey") % 2 == 0, "NAV").otherwise("LIST").alias("intent"))
    return lexical.name_match_topk(q, names).select("qid", "id", F.col("rank").cast("int").alias("rank"))


# ---- vectors ----

def self_queries(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("key"))


SQL_SELF = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, CAST(label AS VARCHAR) AS key, label FROM embeddings), q AS (SELECT id AS qid, v AS qvec, label, [] AS scope, [key] AS own FROM e)"


@query("dense_topk", f"WITH {SQL_SELF}, {sql_dense('d', 'q', 'e', 5)} SELECT qid, id, cosine, rank FROM d")
def dense_topk(t: Tables):
    return dense.dense_topk(self_queries(t), vectors(t), 5).select("qid", "id", "cosine", long("rank"))


@query("retriever_rank", f"""WITH {SQL_SELF}, {sql_dense('d', 'q', 'e', 20)} SELECT qid, id, rank, round(1.0 / (60 + rank), 9) AS weight FROM d""")
def retriever_rank(t: Tables):
    top = dense.dense_topk(self_queries(t), vectors(t), 20)
    return top.select("qid", "id", long("rank"), F.round(1.0 / (60 + F.col("rank")), 9).alias("weight"))


@query("l2_to_cosine", """
SELECT a.vec_id AS a, b.vec_id AS b, round(1 - pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2) / 2, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def l2_to_cosine(t: Tables):
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    d2 = F.aggregate(F.zip_with("x", "y", lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return a.join(b, "a").select("a", "b", F.round(S.l2_to_cosine(d2), 6).alias("cosine"))


@query("dense_filtered", f"WITH {SQL_SELF}, q2 AS (SELECT qid, qvec, own AS scope FROM q), {sql_dense('d', 'q2', 'e', 5)} SELECT qid, id, cosine, rank FROM d")
def dense_filtered(t: Tables):
    q = self_queries(t).withColumn("scope", F.array(F.col("label").cast("string")))
    return dense.dense_topk(q, vectors(t), 5).select("qid", "id", "cosine", long("rank"))


# The greedy choice, one step for each pick after the first.
SQL_PICKS = ", ".join(f"""p{n} AS (SELECT * FROM p{n - 1} UNION ALL SELECT qid, id, {n} FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY 0.5 * cosine - 0.5 * near DESC, cosine DESC, id) AS rn
   FROM (SELECT c.qid, c.id, c.cosine, max(round(list_dot_product(c.v, s.v), 9)) AS near FROM (SELECT * FROM c ANTI JOIN p{n - 1} USING (qid, id)) c JOIN p{n - 1} p ON p.qid = c.qid JOIN e s ON s.id = p.id GROUP BY ALL)) WHERE rn = 1)"""
                      for n in range(2, 6))


@query("mmr", f"""WITH {SQL_SELF}, {sql_dense('d', 'q', 'e', 20)}, c AS (SELECT qid, id, cosine, v FROM d JOIN e USING (id)),
 p1 AS (SELECT qid, id, 1 AS pick FROM d WHERE rank = 1), {SQL_PICKS} SELECT qid, id, CAST(pick AS INTEGER) AS pick FROM p5""")
def mmr(t: Tables):
    return dense.mmr(self_queries(t), vectors(t), 5)


@query("confidence_flag", f"""WITH {SQL_SELF}, q2 AS (SELECT qid, qvec, CASE WHEN qid % 7 = 0 THEN ['none'] ELSE [CAST((label + 1) % 10 AS VARCHAR)] END AS scope FROM q),
 {sql_dense('d', 'q2', 'e', 1)} SELECT qid, coalesce(cosine, 0) AS best_cosine, coalesce(cosine, 0) >= 0.3 AS confident FROM q2 LEFT JOIN d USING (qid)""")
def confidence_flag(t: Tables):
    q = self_queries(t).withColumn("scope", F.when(F.col("qid") % 7 == 0, F.array(F.lit("none"))).otherwise(
        F.array(((F.col("label") + 1) % 10).cast("string"))))
    return dense.confidence_flag(q, dense.dense_topk(q, vectors(t), 1)).select(
        "qid", "best_cosine", "confident")


# ---- fusion ----

SQL_BOTH = f"""WITH {SQL_STATS}, {SQL_VECS}, {SQL_ASK}, qq AS (SELECT qid, {C.sql_terms('text')} AS terms, scope, qvec FROM q JOIN qv USING (qid)),
 open AS (SELECT qid, terms, qvec, [] AS scope FROM qq), {sql_bm25('b', 'open', 20)}, {sql_dense('d', 'open', 'dv', 20)}"""


def both_lists(t: Tables):
    q = questions(t).select("qid", "qvec", X.tokenize_terms(F.col("text")).alias("terms"))
    return (dense.dense_topk(q, chunks(t).select("id", "vec"), 20), lexical.bm25_topk(q, documents(t).select("id", "terms"), 20))


@query("rank_full_outer", SQL_BOTH + " SELECT qid, id, d.rank AS dense_rank, b.rank AS bm25_rank FROM d FULL JOIN b USING (qid, id)")
def rank_full_outer(t: Tables):
    vec, kw = both_lists(t)
    return fusion.rank_full_outer({"dense": vec, "bm25": kw}).select("qid", "id", long("dense_rank"), long("bm25_rank"))


@query("rrf_fuse", SQL_BOTH + """ SELECT qid, id, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(0.25 / (60 + b.rank), 0), 9) AS fused FROM d FULL JOIN b USING (qid, id)""")
def rrf_fuse(t: Tables):
    vec, kw = both_lists(t)
    return fusion.rrf_fuse({"dense": vec, "bm25": kw}).select("qid", "id", "fused")


@query("protect_top1", SQL_BOTH + f", {sql_fuse('h', 'd', 'b', 5)} SELECT qid, id, score, rank FROM h")
def protect_top1(t: Tables):
    vec, kw = both_lists(t)
    return fusion.protect_top1(fusion.rrf_fuse({"dense": vec, "bm25": kw}), 5).select(
        "qid", "id", F.col("fused").alias("score"), long("rank"))


@query("weighted_score_fuse", SQL_BOTH + """, s AS (SELECT qid, id, score / max(score) OVER (PARTITION BY qid) * 0.4 AS s FROM b WHERE rank <= 10
 UNION ALL SELECT qid, id, (1 - (2 - 2 * cosine) / (max(2 - 2 * cosine) OVER (PARTITION BY qid) + 0.01)) * 0.6 FROM d WHERE rank <= 10),
 f AS (SELECT qid, id, round(sum(s), 9) AS score FROM s GROUP BY qid, id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)
SELECT qid, id, score, rank FROM r WHERE rank <= 5""")
def weighted_score_fuse(t: Tables):
    vec, kw = both_lists(t)
    return fusion.weighted_score_fuse(kw, vec, 5).select("qid", "id", "score", long("rank"))


SQL_HYBRID = f"""WITH {SQL_STATS}, {SQL_VECS}, {SQL_ASK}, qq AS (SELECT qid, {C.sql_terms('text')} AS terms, scope, qvec FROM q JOIN qv USING (qid)),
 {sql_bm25('b', 'qq', 20)}, {sql_dense('d', 'qq', 'dv', 20)}, {sql_fuse('h', 'd', 'b', 5)}"""


@query("hybrid_retrieve", SQL_HYBRID + f""" SELECT h.qid, h.id, score, h.rank, dr AS dense_rank, br AS bm25_rank, round(list_dot_product(qvec, v), 9) AS cosine,
 coalesce(t.cosine, 0) AS best_cosine, coalesce(t.cosine, 0) >= {P.MIN_DENSE_COSINE} AS confident
 FROM h JOIN dv ON dv.id = h.id JOIN qv ON qv.qid = h.qid LEFT JOIN (SELECT qid, cosine FROM d WHERE rank = 1) t ON t.qid = h.qid""")
def hybrid_retrieve(t: Tables):
    return fusion.hybrid_retrieve(questions(t), chunks(t), texts=documents(t)).select(
        "qid", "id", "score", long("rank"), long("dense_rank"), long("bm25_rank"), "cosine", "best_cosine", "confident")


@query("resolve_entities", f"WITH {SQL_ASK} SELECT qid, array_to_string(scope, ',') AS ids, stripped FROM q")
def resolve_entities(t: Tables):
    found = entities.resolve_entities(F.col("text"), ALIASES, HOUSE, GENERIC)
    return t.benchmark.select(F.col("item_id").alias("qid"), found.alias("e")).select(
        "qid", F.array_join("e.ids", ",").alias("ids"), F.col("e.stripped").alias("stripped"))


def part_messages(t: Tables):
    """Two part names per message; the second is a plural, and so no whole word, for even keys."""
    a = t.part.select("p_partkey", "p_name")
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return a.join(b, "p_partkey").select("p_partkey", "p_name", "other", F.concat(
        F.lit("Is the acme "), F.upper("p_name"), F.lit(", or "), F.col("other"),
        F.when(F.col("p_partkey") % 2 == 0, "s").otherwise(""), F.lit(" better?")).alias("m"))


@query("alias_match_join", """
WITH m AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT DISTINCT p_partkey, replace(x, ' ', '-') AS entity_id FROM m UNION SELECT p_partkey, replace(y, ' ', '-') FROM m WHERE p_partkey % 2 = 1""")
def alias_match_join(t: Tables):
    names = t.part.select("p_name").distinct()
    known = names.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("entity_id"))
    keyed = names.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("alias_key"), F.col("p_name").alias("alias"))
    aliases = entities.bind_alias_keys(keyed, known)
    return entities.alias_match_join(part_messages(t), aliases, "p_partkey", "m")


@query("alias_hits", r"""
WITH a AS (SELECT 'first' AS entity_id, unnest(['the', 'in the', 'the on']) AS alias UNION ALL SELECT 'second', unnest(['the', 'an in']) UNION ALL
 SELECT 'third', array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[3:14], ' ') FROM benchmark WHERE item_id % 5 = 0),
d AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), '  ') AS t FROM documents),
h AS (SELECT DISTINCT doc_id, entity_id, alias FROM d, a WHERE contains('  ' || t || '  ', '  ' || replace(alias, ' ', '  ') || '  '))
SELECT doc_id, entity_id, count(*) AS aliases FROM h GROUP BY ALL""")
def alias_hits(t: Tables):
    """Which aliases of three entities stand in each document, one of them a table of runs of twelve words; words joined by single blanks."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(P.WORD), 0)
    short = t.spark.createDataFrame([("first", "the"), ("first", "in the"), ("first", "the on"), ("second", "the"), ("second", "an in")], "entity_id string, alias string")
    long_ones = t.benchmark.where("item_id % 5 = 0").select(F.lit("third").alias("entity_id"), F.array_join(F.slice(words, 3, 12), " ").alias("alias"))
    plain = t.documents.select("doc_id", F.array_join(words, " ").alias("m"))
    hits = entities.alias_hits(plain, short.unionByName(long_ones), "doc_id", "m")
    return hits.select("doc_id", "entity_id", "alias").distinct().groupBy("doc_id", "entity_id").agg(F.count("*").alias("aliases"))


@query("strip_aliases", """
SELECT a.p_partkey, 'Is the , or ' || CASE WHEN a.p_partkey % 2 = 1 THEN '?' WHEN lower(a.p_name) = lower(b.p_name) THEN b.p_name || 's ?' ELSE b.p_name || 's ?' END AS stripped
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def strip_aliases(t: Tables):
    names = t.part.select("p_name").distinct()
    aliases = names.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("entity_id"), F.col("p_name").alias("alias"))
    m = part_messages(t)
    found = entities.alias_match_join(m, aliases, "p_partkey", "m")
    return entities.strip_aliases(found, m.select("p_partkey", "m"), aliases, "p_partkey", "m", ["acme"], ["better"])


# ---- quality ----

@query("retrieval_metrics", f"""WITH {SQL_SELF}, {sql_dense('d', 'q', 'e', 6)}, h AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, (SELECT label FROM e WHERE e.id = d.id) AS l FROM d WHERE id <> qid),
 f AS (SELECT qid, min(rank) AS first FROM h JOIN q USING (qid) WHERE l = q.label AND rank <= 5 GROUP BY qid)
SELECT count(*) AS n, round(avg(coalesce(CAST(first <= 1 AS INTEGER), 0)), 6) AS hit_1, round(avg(coalesce(CAST(first <= 3 AS INTEGER), 0)), 6) AS hit_3,
 round(avg(coalesce(CAST(first <= 5 AS INTEGER), 0)), 6) AS hit_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM q LEFT JOIN f USING (qid)""")
def retrieval_metrics(t: Tables):
    q = self_queries(t)
    others = dense.dense_topk(q, vectors(t), 6).where("id <> qid").drop("rank")
    hits = dense.retriever_rank(others, "cosine", "id", 5).join(
        t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("found")), "id").join(q.select("qid", "label"), "qid")
    return evaluation.retrieval_metrics(q, hits, F.col("found") == F.col("label"))


@query("threshold_calibration", f"""WITH {SQL_SELF}, c AS (SELECT * FROM e WHERE label < 7), {sql_dense('d', 'q', 'c', 2)},
 b AS (SELECT qid, label >= 7 AS off_topic, coalesce(max(cosine), 0) AS s FROM q LEFT JOIN (SELECT * FROM d WHERE id <> qid) USING (qid) GROUP BY qid, label),
 i AS (SELECT list_sort(list(s)) AS l, count(*) AS n FROM b WHERE NOT off_topic)
SELECT (SELECT count(*) FROM b WHERE NOT off_topic) AS n_in_scope, (SELECT count(*) FROM b WHERE off_topic) AS n_off_topic, (SELECT count(*) FROM b WHERE NOT off_topic AND s < 0.3) AS refused,
 (SELECT count(*) FROM b WHERE off_topic AND s >= 0.3) AS accepted, l[1] AS low, l[n // 10 + 1] AS p10, l[n // 2 + 1] AS median,
 (SELECT string_agg(CAST(qid AS VARCHAR), ',' ORDER BY s DESC, qid) FROM (SELECT * FROM b WHERE off_topic ORDER BY s DESC, qid LIMIT 4)) AS top_off_topic FROM i""")
def threshold_calibration(t: Tables):
    q = self_queries(t)
    corpus = t.embeddings.where("label < 7").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    others = dense.dense_topk(q, corpus, 2).where("id <> qid").drop("rank")
    best = dense.confidence_flag(q, dense.retriever_rank(others, "cosine", "id", 1))
    scored = q.select("qid", (F.col("label") >= 7).alias("off_topic")).join(best, "qid").select("qid", "off_topic", "best_cosine")
    return evaluation.threshold_calibration(scored)


def _sweep_sql() -> str:
    parts = [f"WITH {SQL_STATS}, {SQL_VECS}, {SQL_ASK}, qq AS (SELECT q.*, qvec, qlabel FROM q JOIN qv USING (qid))"]
    for v, (text, scope) in enumerate((("text", "[]"), ("text", "scope"), ("stripped", "scope"))):
        parts.append(f"q{v} AS (SELECT qid, {C.sql_terms(text)} AS terms, {scope} AS scope, qvec FROM qq)")
        parts += [sql_bm25(f"b{v}", f"q{v}", 20), sql_dense(f"d{v}", f"q{v}", "dv", 20), sql_fuse(f"h{v}", f"d{v}", f"b{v}", 5)]
    runs = " UNION ALL ".join(f"SELECT '{name}' AS config, qid, id, rank FROM {dict(dense='d', bm25='b', hybrid='h')[mode]}{v} WHERE rank <= 5"
                              for name, (mode, v) in fusion.SWEEP.items())
    names = ", ".join(f"('{n}')" for n in fusion.SWEEP)
    return ", ".join(parts) + f""", r AS ({runs}), f AS (SELECT config, qid, min(rank) AS first FROM r JOIN dv USING (id) JOIN qq USING (qid) WHERE label = qlabel GROUP BY ALL)
SELECT config, count(*) AS n, round(avg(coalesce(CAST(first <= 1 AS INTEGER), 0)), 6) AS hit_1, round(avg(coalesce(CAST(first <= 3 AS INTEGER), 0)), 6) AS hit_3,
 round(avg(coalesce(CAST(first <= 5 AS INTEGER), 0)), 6) AS hit_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr
FROM (SELECT config, qid FROM qq, (VALUES {names}) c(config)) LEFT JOIN f USING (config, qid) GROUP BY config"""


@query("config_sweep", _sweep_sql())
def config_sweep(t: Tables):
    q, c = questions(t), chunks(t)
    hits = fusion.config_sweep(q, c, texts=documents(t)).join(c.select("id", "label"), "id").join(q.select("qid", "qlabel"), "qid")
    every = q.select("qid", F.explode(F.array(*[F.lit(n) for n in fusion.SWEEP])).alias("config"))
    return evaluation.retrieval_metrics(every, hits, F.col("label") == F.col("qlabel"), "config")
