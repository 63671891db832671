"""Chunking queries over documents and texts composed from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.operators import chunking as K
from corpusmill.plans import compose as C
from corpusmill.plans.registry import Tables, query

# Document text followed by a table (a glossary for some) and a bullet list; Spark and SQL forms of one text.
TAIL = ("text || chr(10) || chr(10) || text || chr(10) || 'Term | Meaning' || CASE WHEN doc_id % 3 = 0 THEN ' | Note' ELSE '' END || chr(10)"
        " || '---|---' || chr(10) || {rows} || chr(10) || '- lead' || chr(10) || {items}")
ROWS = "array_join(transform(sequence(1, 25 + cast(doc_id % 10 as int)), i -> 'T' || cast(i as string) || ' |  meaning of ' || lang || ' number ' || cast(i as string)), chr(10))"
ITEMS = "array_join(transform(sequence(1, 5 + cast(doc_id % 90 as int)), i -> '- item ' || cast(i as string) || ' of ' || source || ' in ' || lang), chr(10))"
BODY = TAIL.format(rows=ROWS, items=ITEMS)
SQL_BODY = TAIL.format(
    rows="array_to_string(list_transform(range(1, 26 + doc_id % 10), lambda i: 'T' || i || ' |  meaning of ' || lang || ' number ' || i), chr(10))",
    items="array_to_string(list_transform(range(1, 6 + doc_id % 90), lambda i: '- item ' || i || ' of ' || source || ' in ' || lang), chr(10))")

TOK = lambda x: f"CAST({C.sql_tokens(x)} AS INTEGER)"


def sql_pack(items: str, budget: str, prefix: str, joiner: str = "chr(10)") -> str:
    """Greedy packing as a list_reduce over structs {p: pieces, c: current, n: tokens}."""
    elements = f"list_transform({items}, lambda x: {{'p': CAST([] AS VARCHAR[]), 'c': x, 'n': {TOK('x')}}})"
    start = "{'p': CAST([] AS VARCHAR[]), 'c': CAST(NULL AS VARCHAR), 'n': 0}"
    step = (f"CASE WHEN a.c IS NULL THEN {{'p': a.p, 'c': e.c, 'n': e.n}} WHEN a.n + e.n > {budget} THEN {{'p': list_append(a.p, {prefix} || a.c), 'c': e.c, 'n': e.n}} "
            f"ELSE {{'p': a.p, 'c': a.c || {joiner} || e.c, 'n': a.n + e.n}} END")
    done = f"list_reduce({elements}, lambda a, e: {step}, {start})"
    return f"list_transform([{done}], lambda z: CASE WHEN z.c IS NULL THEN z.p ELSE list_append(z.p, {prefix} || z.c) END)[1]"


def sql_recursive(name: str, source: str, keys: str, breaks: tuple[str, ...], last: str, measure) -> str:
    """CTEs that end in ``name`` (keys, ps): texts of ``source`` (keys, t, size, lap) split level by level. A part too large for a
    piece is cut at the next break; the small parts of one cut between two large ones are a run and are joined with overlap."""
    ctes = [f"{name}_0 AS (SELECT {keys}, size, lap, CAST([] AS INTEGER[]) AS up, CAST([] AS INTEGER[]) AS path, t, true AS big FROM ({source}))"]
    for level in range(1, len(breaks) + 2):
        if level <= len(breaks):
            sep = breaks[level - 1]
            parts = f"list_transform(string_split(t, {sep}), lambda x, i: {{'i': CAST(i AS INTEGER), 't': CASE WHEN i = 1 THEN x ELSE {sep} || x END}})"
        else:
            parts = f"list_transform(regexp_extract_all(t, '{last}'), lambda x, i: {{'i': CAST(i AS INTEGER), 't': x}})"
        ctes.append(f"{name}_{level} AS (SELECT * EXCLUDE (part), list_append(up, part.i) AS path, part.t AS t, {measure('part.t')} >= size AND {level} <= {len(breaks)} AS big "
                    f"FROM (SELECT {keys}, size, lap, path AS up, unnest({parts}) AS part FROM {name}_{level - 1} WHERE big) WHERE part.t <> '')")
    every = " UNION ALL BY NAME ".join(f"SELECT * FROM {name}_{level}" for level in range(1, len(breaks) + 2))
    after = "coalesce(list_sum(list_transform(a.w[j:], lambda x: x.n)), 0)"
    keep = f"list_filter(range(1, len(a.w) + 2), lambda j: {after} <= e.lap AND ({after} + e.n <= e.size OR {after} = 0))[1]"
    text = lambda z: C.sql_strip(f"array_to_string(list_transform({z}.w, lambda x: x.t), '')")
    popped = f"list_transform([a.w[({keep}):]], lambda w: {{'p': list_append(a.p, {text('a')}), 'w': list_concat(w, e.w), 'n': CAST(coalesce(list_sum(list_transform(w, lambda x: x.n)), 0) + e.n AS INTEGER), 'size': e.size, 'lap': e.lap}})[1]"
    step = f"CASE WHEN a.n + e.n > e.size THEN {popped} ELSE {{'p': a.p, 'w': list_concat(a.w, e.w), 'n': CAST(a.n + e.n AS INTEGER), 'size': e.size, 'lap': e.lap}} END"
    ctes.append(f"""{name}_run AS (SELECT *, {measure('t')} AS n, sum(CAST(big AS INTEGER)) OVER (PARTITION BY {keys}, up ORDER BY path) AS run FROM ({every})),
 {name}_list AS (SELECT {keys}, min(path) AS path, list({{'p': CAST([] AS VARCHAR[]), 'w': [{{'t': t, 'n': n}}], 'n': n, 'size': size, 'lap': lap}} ORDER BY path) AS l
   FROM {name}_run WHERE NOT big GROUP BY {keys}, up, run),
 {name}_done AS (SELECT {keys}, path, list_reduce(l, lambda a, e: {step}) AS z FROM {name}_list),
 {name} AS (SELECT {keys}, list_filter(flatten(list(list_append(z.p, {text('z')}) ORDER BY path)), lambda x: x <> '') AS ps FROM {name}_done GROUP BY {keys})""")
    return ",\n ".join(ctes)


def sql_prose(name: str, source: str, keys: str) -> str:
    return sql_recursive(name, f"SELECT {keys}, t, 350 AS size, 50 AS lap FROM {source}", keys, ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"),
                         f"^{C.NW}*{C.W}+{C.NW}*|{C.W}+{C.NW}*", TOK)


def sql_merge(pieces: str) -> str:
    """``pieces``: list of {t, a}."""
    elements = f"list_transform({pieces}, lambda x: {{'p': CAST([] AS VARCHAR[]), 'c': x.t, 'a': x.a, 'n': {TOK('x.t')}}})"
    start = "{'p': CAST([] AS VARCHAR[]), 'c': CAST(NULL AS VARCHAR), 'a': false, 'n': 0}"
    step = ("CASE WHEN a.c IS NOT NULL AND NOT a.a AND NOT e.a AND a.n + e.n <= 350 THEN {'p': a.p, 'c': a.c || chr(10) || e.c, 'a': false, 'n': a.n + e.n} "
            "ELSE {'p': CASE WHEN a.c IS NULL THEN a.p ELSE list_append(a.p, a.c) END, 'c': e.c, 'a': e.a, 'n': e.n} END")
    done = f"list_reduce({elements}, lambda a, e: {step}, {start})"
    return f"list_transform([{done}], lambda z: CASE WHEN z.c IS NULL THEN z.p ELSE list_append(z.p, z.c) END)[1]"


def sql_lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


KIND = r"CASE WHEN contains(line, '|') THEN 'table' WHEN regexp_matches(line, '^\s*[-*] ') THEN 'list' ELSE 'text' END"


def sql_blocks(body: str) -> str:
    return f"""d AS (SELECT doc_id, {body} AS b FROM documents),
 ln AS (SELECT doc_id, unnest({sql_lines('b')}) AS line, generate_subscripts({sql_lines('b')}, 1) AS pos FROM d),
 kd AS (SELECT *, {KIND} AS kind FROM ln), ch AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM kd),
 bl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM ch),
 blocks AS (SELECT doc_id, block, first(kind) AS kind, list(line ORDER BY pos) AS lines FROM bl GROUP BY doc_id, block)"""


SQL_TABLE_SPLIT = (f"list_transform([{{'h': CASE WHEN regexp_matches(lines[2], '^[\\s|:-]+$') THEN lines[1:2] ELSE [] END, "
                   f"'r': CASE WHEN regexp_matches(lines[2], '^[\\s|:-]+$') THEN lines[3:] ELSE lines END}}], lambda s: CASE WHEN len(string_split(lines[1], '|')) = 2 AND len(s.r) >= 30 "
                   f"THEN list_transform(list_filter(s.r, lambda r: {C.sql_strip('r')} <> ''), lambda r: CASE WHEN contains(r, '|') THEN trim(split_part(r, '|', 1)) || ': ' || trim(substr(r, strpos(r, '|') + 1)) ELSE trim(r) END) "
                   f"ELSE {sql_pack('s.r', '350 - ' + TOK('array_to_string(s.h, chr(10))'), 'CASE WHEN len(s.h) > 0 THEN array_to_string(s.h, chr(10)) || chr(10) ELSE chr(32)[:0] END')} END)[1]")
SQL_ATOMIC = ("len(string_split(lines[1], '|')) = 2 AND (CASE WHEN regexp_matches(lines[2], '^[\\s|:-]+$') THEN len(lines) - 2 ELSE len(lines) END) >= 30")
SQL_PIECES = f"""tx AS (SELECT *, {C.sql_strip('array_to_string(lines, chr(10))')} AS t FROM blocks),
 {sql_prose('prose', f"tx WHERE kind = 'text' AND {TOK('t')} > 350", 'doc_id, block')},
 pc AS (SELECT doc_id, block, CASE WHEN t = '' THEN [] WHEN kind = 'table' THEN {SQL_TABLE_SPLIT} WHEN {TOK('t')} > 350 AND kind = 'list' THEN {sql_pack('lines', '350', "''")}
   WHEN {TOK('t')} > 350 THEN prose.ps ELSE [t] END AS ps, kind = 'table' AND {SQL_ATOMIC} AS atomic FROM tx LEFT JOIN prose USING (doc_id, block)),
 fl AS (SELECT doc_id, flatten(list(list_transform(ps, lambda x: {{'t': x, 'a': atomic}}) ORDER BY block)) AS ps FROM pc GROUP BY doc_id),
 parts AS (SELECT d.doc_id, CASE WHEN {TOK('b')} <= 400 THEN [b] ELSE {sql_merge('ps')} END AS ps FROM d JOIN fl USING (doc_id))"""


def explode(df, column, *keep):
    return df.select(*keep, F.posexplode(column).alias("part_no", "text"))


@query("block_types", f"WITH {sql_blocks(SQL_BODY)} SELECT doc_id, CAST(block - 1 AS INTEGER) AS block_no, kind, array_to_string(lines, chr(10)) AS text FROM blocks")
def block_types(t: Tables):
    return t.documents.select("doc_id", F.posexplode(K.block_types(F.expr(BODY))).alias("block_no", "b")).select(
        "doc_id", "block_no", "b.kind", F.array_join("b.lines", "\n").alias("text"))


@query("greedy_pack", f"""WITH d AS (SELECT doc_id, {sql_pack(sql_lines('text'), '350 - 2', "'Intro line' || chr(10)")} AS p FROM documents)
SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part_no, unnest(p) AS text FROM d""")
def greedy_pack(t: Tables):
    packed = K.greedy_pack(F.split("text", "\n", -1), F.lit("Intro line"))
    return explode(t.documents, packed, "doc_id")


@query("table_split", f"""WITH {sql_blocks(SQL_BODY)}, s AS (SELECT doc_id, block, {SQL_TABLE_SPLIT} AS p, {SQL_ATOMIC} AS atomic FROM blocks WHERE kind = 'table')
SELECT doc_id, CAST(block - 1 AS INTEGER) AS block_no, atomic, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part_no, unnest(p) AS text FROM s""")
def table_split(t: Tables):
    b = t.documents.select("doc_id", F.posexplode(K.block_types(F.expr(BODY))).alias("block_no", "b")).where("b.kind = 'table'")
    return b.select("doc_id", "block_no", K.table_split(F.col("b.lines")).alias("s")).select(
        "doc_id", "block_no", "s.atomic", F.posexplode("s.pieces").alias("part_no", "text"))


SQL_DOUBLE = "text || chr(10) || chr(10) || 'Short close.' || chr(10) || chr(10) || text"


@query("prose_split", f"""WITH {sql_prose('prose', f"(SELECT doc_id, {SQL_DOUBLE} AS t FROM documents)", 'doc_id')}
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS part_no, unnest(ps) AS text FROM prose""")
def prose_split(t: Tables):
    return explode(t.documents, K.prose_split(F.expr(SQL_DOUBLE)), "doc_id")


@query("merge_small", f"""WITH d AS (SELECT doc_id, {sql_merge("list_transform(string_split(text, chr(10)), lambda l: {'t': l, 'a': len(l) % 10 = 0})")} AS p FROM documents)
SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part_no, unnest(p) AS text FROM d""")
def merge_small(t: Tables):
    pieces = F.transform(F.split("text", "\n", -1), lambda x: F.struct(
        x.alias("text"), (F.length(x) % 10 == 0).alias("atomic"), K.token_count(x).alias("n")))
    return explode(t.documents, K.merge_small(pieces), "doc_id")


@query("split_document", f"""WITH {sql_blocks(SQL_BODY)}, {SQL_PIECES}
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS part_no, unnest(ps) AS text FROM parts""")
def split_document(t: Tables):
    return explode(t.documents, K.split_document(F.col("source"), F.expr(BODY)), "doc_id")


SQL_CHUNKS = f"""WITH {sql_blocks(SQL_BODY)}, {SQL_PIECES},
 mt AS (SELECT doc_id, source, lang, CASE doc_id % 3 WHEN 0 THEN '[Fund ' || source || ' | ' || CASE WHEN doc_id % 2 = 0 THEN 'FAQ' ELSE lang END || ']'
   WHEN 1 THEN '[Site Help Centre: mutual funds FAQ]' ELSE '[Site blog: ' || source || CASE WHEN lang = 'en' THEN '' ELSE ' > ' || lang END || ' > T' || doc_id || ']' END AS h FROM documents),
 ck AS (SELECT doc_id, source, h, len(ps) AS n, unnest(ps) AS t, generate_subscripts(ps, 1) AS i FROM parts JOIN mt USING (doc_id)),
 tx2 AS (SELECT doc_id, source, n, i, CASE WHEN n = 1 THEN h ELSE left(h, len(h) - 1) || ' | part ' || i || ' of ' || n || ']' END || chr(10) || {C.sql_strip('t')} AS text FROM ck)
"""


def chunked(t: Tables):
    d = t.documents.select(
        F.col("doc_id").alias("id"), "source", F.expr(BODY).alias("body"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'scheme_faq' WHEN 1 THEN 'help_faq' ELSE 'blog_section' END").alias("doc_type"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'faq' ELSE lang END").alias("section"), F.concat(F.lit("Fund "), "source").alias("scheme_name"),
        F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("parent"))
    header = K.context_header(F.col("doc_type"), F.col("section"), F.col("scheme_name"), F.col("title"), F.col("source"),
                              F.col("parent"), "Site")
    return K.chunk_table(d, header, K.split_counted(F.col("body")), ["source"])


@query("chunk_table", SQL_CHUNKS + f"""SELECT doc_id || '-' || (i - 1) AS chunk_id, doc_id, text, source, CAST(i - 1 AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS n_chunks, {TOK('text')} AS tokens FROM tx2""")
def chunk_table(t: Tables):
    return chunked(t)


@query("chunk_numbering", """
SELECT source, doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY source, lang) AS INTEGER) AS n_chunks,
 CASE WHEN count(*) OVER (PARTITION BY source, lang) > 1 THEN 'part ' || row_number() OVER w || ' of ' || count(*) OVER (PARTITION BY source, lang) END AS label
FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)""")
def chunk_numbering(t: Tables):
    # pieces that already are rows: numbered by cells, so a source that holds a third of all rows stays spread
    from corpusmill.operators.dedupe import occurrence_no
    rows = occurrence_no(t.documents.select("doc_id", "source", "lang"), ["source", "lang"], "doc_id")
    counts = t.documents.groupBy("source", "lang").agg(F.count("*").cast("int").alias("n_chunks"))
    no = F.col("occurrence_no").cast("int")
    return rows.join(counts, ["source", "lang"]).select(
        "source", "doc_id", no.alias("chunk_index"), "n_chunks", F.when(F.col("n_chunks") > 1, F.concat(
            F.lit("part "), (no + 1).cast("string"), F.lit(" of "), F.col("n_chunks").cast("string"))).alias("label"))


SETTINGS = {"en": (800, 80), "de": (1000, 150), "fr": (800, 120)}


SQL_SETTINGS = "CASE lang WHEN 'en' THEN {} WHEN 'de' THEN {} WHEN 'fr' THEN {} END"
SQL_LIMITED = (f"SELECT doc_id, text AS t, {SQL_SETTINGS.format(*[size for size, _ in SETTINGS.values()])} AS size, "
               f"{SQL_SETTINGS.format(*[lap for _, lap in SETTINGS.values()])} AS lap FROM documents WHERE lang IN ('en', 'de', 'fr')")


@query("section_chunking", f"""
WITH {sql_recursive('cut', SQL_LIMITED, 'doc_id', ("chr(10) || chr(10)", "chr(10)", "' '"), '(?s).', lambda x: f"CAST(length({x}) AS INTEGER)")},
 w AS (SELECT d.doc_id, lang, CASE WHEN lang IN ('en', 'de', 'fr') THEN ps ELSE [text] END AS p FROM documents d LEFT JOIN cut USING (doc_id))
SELECT doc_id, lang, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS chunk_index, unnest(p) AS text FROM w""")
def section_chunking(t: Tables):
    return K.section_chunking(t.documents.select("doc_id", "lang", "text"), "lang", "text", SETTINGS)


@query("chunk_size_check", SQL_CHUNKS + f"SELECT doc_id || '-' || (i - 1) AS chunk_id, {TOK('text')} AS tokens FROM tx2 WHERE {TOK('text')} > 350")
def chunk_size_check(t: Tables):
    # the shipped limit finds nothing in valid chunks, so the check runs at the target size here
    return K.chunk_size_check(chunked(t), P.CHUNK_TARGET_TOKENS)
