"""The queries of this folder over whole tables, with the SQL they must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build
    return register


@query("op8_mixing")
def op8_mixing(spark, folder):
    from corpusmill.llm.mixing import mix
    docs = read(spark, folder, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op10_winnowing")
def op10_winnowing(spark, folder):
    from corpusmill.llm.winnowing import compare_with_next, marks_text
    near = compare_with_next(read(spark, folder, "documents").select("doc_id", "text"))
    return near.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       marks_text("hashes", "positions").alias("fingerprint"),
                       marks_text("edited_hashes", "edited_positions").alias("edited_fingerprint"), "near_edited", "near_next")


@query("op3_forced_bpe")
def op3_forced_bpe(spark, folder):
    from corpusmill.llm.bpe import default_path, encode_decode
    coded = encode_decode(read(spark, folder, "documents").select("doc_id", "text"), default_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def fold(n: int):
    """Remainder of the checksum of the document's id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query("op5_language")
def op5_language(spark, folder):
    from corpusmill.llm.language import fit, identify
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    learned = fit(docs, fold(4) != 2)
    told = identify(docs.select("doc_id", "text", (fold(4) == 2).alias("held_out")), learned)
    return told.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op7_quality")
def op7_quality(spark, folder):
    from corpusmill.llm.quality import fit, score
    docs = read(spark, folder, "documents").select("doc_id", "text")
    forest = fit(docs, read(spark, folder, "labels").where(fold(5) != 0))
    scored = score(docs.withColumn("held_out", fold(5) == 0), forest)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op4_exact_topk(spark, folder):
    from corpusmill.llm.exact_topk import exact_topk
    vectors = read(spark, folder, "embeddings")
    return exact_topk(vectors.where("vec_id % 20 = 0"), vectors)


@query("op2_html_text")
def op2_html_text(spark, folder):
    from corpusmill.llm.html_text import extract
    text = extract(read(spark, folder, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op6_preferences", """
WITH t AS (SELECT conv_id AS pair_id, turn, min((coalesce(role, 'unknown'), coalesce(text, ''))) AS s FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
u AS (SELECT pair_id, turn, s[1] AS role, s[2] AS text FROM t),
b AS (SELECT conv_id AS pair_id, max(turn) AS last, min(turn) AS earliest, arg_min(text, turn) AS reply FROM conversations
      WHERE role = 'assistant' GROUP BY conv_id),
v AS (SELECT u.*, CASE WHEN role = 'assistant' AND turn = last THEN CASE WHEN earliest < last THEN coalesce(reply, '') ELSE '' END
                       ELSE text END AS other FROM u LEFT JOIN b USING (pair_id)),
f AS (SELECT pair_id, min(CASE WHEN text <> other THEN turn END) AS first FROM v GROUP BY pair_id),
w AS (SELECT v.*, first IS NULL OR turn < first AS shared, '<|im_start|>' || role || chr(10) AS head, '<|im_end|>' || chr(10) AS tail
      FROM v JOIN f USING (pair_id)),
o AS (SELECT *, sum(length(head) + length(text) + 11) OVER p - length(text) - 11 AS cs,
             sum(length(head) + length(other) + 11) OVER p - length(other) - 11 AS rs
      FROM w WINDOW p AS (PARTITION BY pair_id, shared ORDER BY turn)),
n AS (SELECT pair_id, CAST(count(*) FILTER (shared) AS BIGINT) AS n_common FROM w GROUP BY pair_id)
SELECT pair_id, turn // 256 AS segment, n_common,
       coalesce(string_agg(head || text || tail, '' ORDER BY turn) FILTER (shared), '') AS prompt,
       coalesce(string_agg(head || text || tail, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
       coalesce(string_agg(CAST(cs AS BIGINT) || ':' || CAST(cs + length(text) + 10 AS BIGINT), ',' ORDER BY turn)
                FILTER (NOT shared AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(head || other || tail, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected,
       coalesce(string_agg(CAST(rs AS BIGINT) || ':' || CAST(rs + length(other) + 10 AS BIGINT), ',' ORDER BY turn)
                FILTER (NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM o JOIN n USING (pair_id) GROUP BY pair_id, turn // 256, n_common""")
def op6_preferences(spark, folder):
    from corpusmill.llm.preferences import preference_pairs, with_first_reply
    said = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return preference_pairs(said.withColumnRenamed("conv_id", "pair_id"), with_first_reply(said).withColumnRenamed("conv_id", "pair_id"))


@query("op9_pii")
def op9_pii(spark, folder):
    from corpusmill.llm.pii import BASE_KINDS, find, fit, span_text
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


@query("op1_ngram_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, len(ws) AS m, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT doc_id, m, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS x FROM u
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT DISTINCT doc_id, hash(x) AS g FROM v WHERE i <= greatest(m - 4, 1)),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN h USING (doc_id) GROUP BY doc_id),
g AS (SELECT * FROM h SEMI JOIN (SELECT g FROM h GROUP BY g HAVING count(*) > 1) USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)
SELECT doc_id, n AS n_shingles, min(c) AS component_id FROM n JOIN r ON r.d = doc_id GROUP BY ALL""")
def op1_ngram_join(spark, folder):
    from corpusmill.llm.ngram_join import jaccard_join
    return jaccard_join(read(spark, folder, "documents"))


@query("op11_fill_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, CAST('0x' || s[1:8] AS BIGINT) AS h1,
  CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM h),
p AS (SELECT doc_id, t, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""")
def op11_fill_middle(spark, folder):
    from corpusmill.llm.fill_middle import fill_in_middle, restored
    made = fill_in_middle(read(spark, folder, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def kmeans_sql(rounds: int = 3) -> str:
    """Each round as two tables: squared distances to every centroid, and floors of the means."""
    def nearest(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT v.vec_id, v.q, min({{'d': list_sum(list_transform(list_zip(v.q, c.q),
  lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS m FROM v, c{i} c GROUP BY ALL)"""

    def means(i: int) -> str:
        return f"""s{i} AS (SELECT m.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{i}) GROUP BY ALL),
g{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(g.q, c.q) AS q FROM c{i} c LEFT JOIN g{i} g USING (c))"""

    steps = ",\n".join(x for i in range(rounds) for x in (nearest(i), means(i)))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS c, q FROM
  (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, vec_id, q FROM v ORDER BY h, vec_id LIMIT 16)),
{steps},
{nearest(rounds)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m.c"""


@query("op12_lookup_kmeans", kmeans_sql())
def op12_lookup_kmeans(spark, folder):
    from corpusmill.llm.lookup_kmeans import cluster
    rows = cluster(read(spark, folder, "embeddings"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                       F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


@query("op13_jump_shards", r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(crc ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) r(n))),
d AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b,
  sha256(coalesce('+' || CAST(doc_id AS VARCHAR), '-')) AS h FROM documents),
k AS MATERIALIZED (SELECT doc_id, CAST('0x' || h[1:15] AS HUGEINT) AS k, CAST(len(b) AS BIGINT) + 1 AS size,
  xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
j AS (SELECT k AS key, n, k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM (SELECT DISTINCT k FROM k), (VALUES (16), (17)) s(n)
  UNION ALL
  SELECT key, n, s, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(s // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT key, n, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM j WHERE j < n)),
e AS (SELECT key, CAST(max(b) FILTER (n = 16) AS INTEGER) AS shard, CAST(max(b) FILTER (n = 17) AS INTEGER) AS grown_shard FROM j GROUP BY key)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM k JOIN e ON e.key = k.k""")
def op13_jump_shards(spark, folder):
    from corpusmill.llm.jump_shards import manifest
    return manifest(read(spark, folder, "documents").select("doc_id", "text"))
