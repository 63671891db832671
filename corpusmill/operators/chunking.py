"""Documents to retrieval-sized chunks, as folds inside the row.

Sizes are counts of word tokens; joining two texts with a line break adds their counts, so each fold carries a running
count, a body's count is the sum of its blocks' and pieces keep their counts. No function here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions.scalars import heading_path, label_map
from corpusmill.functions.text import SPACE, let, lines, rep, strip, token_count

PIECE = "array<struct<text:string,atomic:boolean,n:int>>"
STRINGS = "array<string>"
COUNTED = "array<struct<text:string,n:int>>"
# White space that may stand before a bullet.
INDENT = "".join(x for x in SPACE if x not in "\x1c\x1d\x1e\x1f")


def block_types(c: Column) -> Column:
    """array<struct<kind, lines>>: neighbouring lines of one kind (table, list, text) together."""
    def kind(line: Column) -> Column:
        bullet = let(F.ltrim(line, F.lit(INDENT)), lambda x: x.startswith("- ") | x.startswith("* "))
        return F.when(F.contains(line, F.lit("|")), "table").when(bullet, "list").otherwise("text")

    def blocks(ls: Column, kinds: Column) -> Column:
        edge = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: (i == 1) | (F.element_at(kinds, i) != F.element_at(kinds, F.greatest(i - 1, F.lit(1)))))
        return let(edge, lambda starts: F.transform(starts, lambda s, k: F.struct(
            F.element_at(kinds, s).alias("kind"),
            F.slice(ls, s, F.coalesce(F.try_element_at(starts, k + 2), F.size(ls) + 1) - s).alias("lines"))))

    # Neighbours are compared and each block is one slice, so the work grows with the number of lines.
    found = let(lines(c), lambda ls: let(F.transform(ls, kind), lambda kinds: blocks(ls, kinds)))
    return F.coalesce(found, F.array().cast("array<struct<kind:string,lines:array<string>>>"))


def greedy_pack(items: Column, header: Column | None = None, target: int = P.CHUNK_TARGET_TOKENS,
                joiner: str = "\n") -> Column:
    """Items packed in order into pieces of about ``target`` tokens, the header repeated in every piece.

    An item larger than a piece stays alone.
    """
    head = F.lit("") if header is None else header
    budget = F.lit(target) - token_count(head)
    prefix = F.when(head == "", F.lit("")).otherwise(F.concat(head, F.lit(joiner)))

    def pack(h: Column) -> Column:
        counted = F.transform(items, lambda x: F.struct(x.alias("t"), token_count(x).alias("n")))
        start = F.struct(F.array().cast(STRINGS).alias("pieces"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

        def closed(acc: Column) -> Column:
            return F.when(acc["cur"].isNull(), acc["pieces"]).otherwise(
                F.concat(acc["pieces"], F.array(F.concat(h["prefix"], acc["cur"]))))

        def grow(acc: Column, x: Column) -> Column:
            full = acc["cur"].isNotNull() & (acc["n"] + x["n"] > h["budget"])
            fresh = full | acc["cur"].isNull()
            return F.struct(
                F.when(full, closed(acc)).otherwise(acc["pieces"]).alias("pieces"),
                F.when(fresh, x["t"]).otherwise(F.concat(acc["cur"], F.lit(joiner), x["t"])).alias("cur"),
                F.when(fresh, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"))

        return F.aggregate(counted, start, grow, closed)

    return let(F.struct(prefix.alias("prefix"), budget.alias("budget")), pack)


def table_split(ls: Column, target: int = P.CHUNK_TARGET_TOKENS, glossary_rows: int = P.GLOSSARY_MIN_ROWS) -> Column:
    """struct<pieces, atomic> of a pipe table: one piece per term of a long two-column table, else packed rows."""
    has_header = F.coalesce(F.try_element_at(ls, F.lit(2)).rlike(r"(?U)^[\s|:-]+$"), F.lit(False))
    none = F.slice(ls, 1, 0)

    def split(p: Column) -> Column:
        glossary = (F.size(F.split(ls[0], r"\|", -1)) == 2) & (F.size(p["rows"]) >= glossary_rows)
        terms = F.transform(F.filter(p["rows"], lambda r: strip(r) != ""),
                            lambda r: F.array_join(F.transform(F.split(r, r"\|", 2), strip), ": "))
        packed = greedy_pack(p["rows"], F.array_join(p["header"], "\n"), target)
        return F.struct(F.when(glossary, terms).otherwise(packed).alias("pieces"), glossary.alias("atomic"))

    return let(F.struct(
        F.when(has_header, F.slice(ls, 1, 2)).otherwise(none).alias("header"),
        F.when(has_header, F.slice(ls, F.lit(3), F.size(ls))).otherwise(ls).alias("rows")), split)


PROSE_BREAKS = ("\n\n", "\n", ". ", " ")
PLAIN_BREAKS = ("\n\n", "\n", " ")
_W, _NW = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
ONE_TOKEN = rf"\A{_NW}*{_W}+{_NW}*|{_W}+{_NW}*"
ATOMS = "array<struct<t:string,n:int,level:int,first:boolean>>"


def parts_at(text: Column, level: int, breaks: tuple[str, ...], last: str) -> Column:
    """The text cut at one break, which stays with the part behind it; no part is empty."""
    if level == len(breaks):
        return F.regexp_extract_all(text, F.lit(last), F.lit(0))
    found = F.split(text, f"\\Q{breaks[level]}\\E", -1)
    return F.filter(F.transform(found, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(breaks[level]), x))), lambda x: x != "")


def first_atoms(c: Column, breaks: tuple[str, ...], last: str, measure=token_count) -> Column:
    """The whole text cut at the coarsest break: even a small one is cut and joined by the same rule."""
    return F.transform(parts_at(c, 0, breaks, last), lambda x, i: F.struct(
        x.alias("t"), measure(x).alias("n"), F.lit(0).alias("level"), (i == 0).alias("first"))).cast(ATOMS)


def recursive_split(c: Column, size: Column, overlap: Column, breaks: tuple[str, ...], last: str, measure=token_count) -> Column:
    """Pieces of at most ``size``, cut at the coarsest break that makes them small enough, neighbours joined again with
    up to ``overlap`` of the piece before.

    A part of ``size`` or more is cut at the next finer break, in the end at every match of ``last``. A break stays with the
    part behind it. Only parts that come from one cut and lie side by side are joined. ``measure`` must add up over parts.
    Every level reads the parts once and a piece is one slice of them, so the work grows with the text.
    """
    found = joined_atoms(first_atoms(c, breaks, last, measure), size, overlap, breaks, last, measure)
    return F.transform(found, lambda x: x["text"])


def joined_atoms(atoms: Column, size: Column, overlap: Column, breaks: tuple[str, ...], last: str, measure=token_count) -> Column:
    """Pieces, array<struct<text, n>>, from the parts of the coarsest cut; ``n`` is what the parts of a piece add up to."""
    def cut(level: int, a: Column) -> Column:
        # A part without the break stays as it is and has been measured.
        finer = let(parts_at(a["t"], level, breaks, last), lambda ps: F.transform(ps, lambda x, i: F.struct(
            x.alias("t"), F.when(F.size(ps) == 1, a["n"]).otherwise(measure(x)).alias("n"), F.lit(level).alias("level"), (i == 0).alias("first"))))
        return F.when(a["n"] >= size, finer).otherwise(F.array(a))

    def refined(atoms: Column, level: int) -> Column:
        return F.flatten(F.transform(atoms, lambda a: cut(level, a)))

    for level in range(1, len(breaks) + 1):
        atoms = refined(atoms, level)

    def joined(ats: Column) -> Column:
        span = "array<struct<s:int,e:int,n:int>>"
        start = F.struct(F.array().cast(span).alias("spans"), F.lit(1).alias("s"), F.lit(0).alias("n"))

        def state(spans: Column, s: Column, n: Column) -> Column:
            return F.struct(spans.alias("spans"), s.alias("s"), n.alias("n"))

        def closed(acc: Column, end: Column) -> Column:
            return F.when(end < acc["s"], acc["spans"]).otherwise(
                F.concat(acc["spans"], F.array(F.struct(acc["s"].alias("s"), end.alias("e"), acc["n"].alias("n")))))

        def grow(acc: Column, i: Column) -> Column:
            def step(x: Column) -> Column:
                before = F.try_element_at(ats, F.greatest(i - 1, F.lit(1)))
                fresh = x["first"] | (before["level"] != x["level"])
                full = acc["n"] + x["n"] > size

                def drop(left: Column, y: Column) -> Column:
                    over = (left["n"] > overlap) | ((left["n"] + x["n"] > size) & (left["n"] > 0))
                    return F.when(over, F.struct((left["s"] + 1).alias("s"), (left["n"] - y["n"]).alias("n"))).otherwise(left)

                lap = F.aggregate(F.slice(ats, acc["s"], i - acc["s"]), F.struct(acc["s"].alias("s"), acc["n"].alias("n")), drop)
                return (F.when(fresh, state(closed(acc, i - 1), i, x["n"]))
                        .when(full, let(lap, lambda left: state(closed(acc, i - 1), left["s"], left["n"] + x["n"])))
                        .otherwise(state(acc["spans"], acc["s"], acc["n"] + x["n"])))
            return let(F.element_at(ats, i), step)

        spans = F.aggregate(F.sequence(F.lit(1), F.size(ats)), start, grow, lambda acc: closed(acc, F.size(ats)))
        found = F.transform(spans, lambda p: F.struct(strip(F.array_join(F.transform(
            F.slice(ats, p["s"], p["e"] - p["s"] + 1), lambda x: x["t"]), "")).alias("text"), p["n"].alias("n")))
        return F.when(F.size(ats) > 0, F.filter(found, lambda x: x["text"] != "")).otherwise(F.array().cast(COUNTED))

    return let(atoms, joined)


def prose_split(c: Column, target: int = P.CHUNK_TARGET_TOKENS, overlap: int = P.CHUNK_OVERLAP_TOKENS) -> Column:
    """Paragraphs, then lines, sentences, words and single tokens, in pieces of at most ``target`` tokens that overlap."""
    return recursive_split(c, F.lit(target), F.lit(overlap), PROSE_BREAKS, ONE_TOKEN)


def merge_small(pieces: Column, target: int = P.CHUNK_TARGET_TOKENS) -> Column:
    """Left-to-right merge of neighbouring non-atomic pieces while they fit. ``pieces``: struct<text, atomic, n>."""
    return F.transform(merge_counted(pieces, target), lambda x: x["text"])


def merge_counted(pieces: Column, target: int = P.CHUNK_TARGET_TOKENS) -> Column:
    """The same as array<struct<text, n>>."""
    start = F.struct(F.array().cast(COUNTED).alias("done"), F.lit(None).cast("string").alias("cur"),
                     F.lit(False).alias("atomic"), F.lit(0).alias("n"))

    def closed(acc: Column) -> Column:
        return F.when(acc["cur"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["cur"].alias("text"), acc["n"].alias("n")))))

    def grow(acc: Column, x: Column) -> Column:
        join = acc["cur"].isNotNull() & ~acc["atomic"] & ~x["atomic"] & (acc["n"] + x["n"] <= target)
        return F.struct(
            F.when(join, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(join, F.concat(acc["cur"], F.lit("\n"), x["text"])).otherwise(x["text"]).alias("cur"),
            x["atomic"].alias("atomic"), F.when(join, acc["n"] + x["n"]).otherwise(x["n"]).alias("n"))

    return F.aggregate(pieces, start, grow, closed)


def counted(texts: Column, atomic: Column | None = None) -> Column:
    flag = F.lit(False) if atomic is None else atomic
    return F.transform(texts, lambda x: F.struct(x.alias("text"), flag.alias("atomic"), token_count(x).alias("n")))


def split_body(c: Column, limit: int = P.CHUNK_MAX_TOKENS, target: int = P.CHUNK_TARGET_TOKENS,
               overlap: int = P.CHUNK_OVERLAP_TOKENS) -> Column:
    """One document body as pieces: structure first, then prose, then small neighbours merged."""
    return F.transform(split_counted(c, limit, target, overlap), lambda x: x["text"])


def split_counted(c: Column, limit: int = P.CHUNK_MAX_TOKENS, target: int = P.CHUNK_TARGET_TOKENS,
                  overlap: int = P.CHUNK_OVERLAP_TOKENS) -> Column:
    """The same as array<struct<text, n>>: no text is counted again once its parts are."""
    none, size, lap = F.array().cast(ATOMS), F.lit(target), F.lit(overlap)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x["n"])

    def measured(b: Column) -> Column:
        """A block with its text, its count and, for prose, the counted parts of the coarsest cut."""
        def cut(text: Column) -> Column:
            atoms = F.when(b["kind"] == "text", first_atoms(text, PROSE_BREAKS, ONE_TOKEN)).otherwise(none)
            return let(atoms, lambda ats: F.struct(
                b["kind"].alias("kind"), b["lines"].alias("lines"), text.alias("text"), ats.alias("atoms"),
                F.when(b["kind"] == "text", total(ats)).otherwise(token_count(text)).alias("n")))

        return let(strip(F.array_join(b["lines"], "\n")), cut)

    def pieces(b: Column) -> Column:
        big = b["n"] > target
        prose = F.transform(joined_atoms(b["atoms"], size, lap, PROSE_BREAKS, ONE_TOKEN), lambda x: F.struct(
            x["text"].alias("text"), F.lit(False).alias("atomic"), x["n"].alias("n")))
        return (F.when(b["text"] == "", F.array().cast(PIECE))
                .when(b["kind"] == "table", let(table_split(b["lines"], target), lambda t: counted(t["pieces"], t["atomic"])))
                .when(big & (b["kind"] == "list"), counted(greedy_pack(b["lines"], None, target)))
                .when(big, prose)
                .otherwise(F.array(F.struct(b["text"].alias("text"), F.lit(False).alias("atomic"), b["n"].alias("n")))))

    def split(body: Column, blocks: Column) -> Column:
        merged = merge_counted(F.flatten(F.transform(blocks, pieces)), target)
        return let(total(blocks), lambda n: F.when(body.isNotNull() & (n <= limit), F.array(
            F.struct(body.alias("text"), n.alias("n")))).otherwise(merged))

    return let(c, lambda body: let(F.transform(block_types(body), measured), lambda blocks: split(body, blocks)))


def split_profiles(c: Column, limit: int = P.CHUNK_MAX_TOKENS, target: int = P.CHUNK_TARGET_TOKENS) -> Column:
    """Profile lists keep their first line with every group of profiles."""
    return F.when(token_count(c) <= limit, F.array(c)).otherwise(let(lines(c), lambda ls: greedy_pack(
        F.slice(ls, F.lit(2), F.size(ls)), ls[0], target)))


def split_document(section: Column, c: Column) -> Column:
    return F.when(section == "fund_managers", split_profiles(c)).otherwise(split_body(c))


def context_header(doc_type: Column, section: Column, scheme_name: Column, title: Column, page_title: Column,
                   parent: Column, site: str) -> Column:
    """Bracketed line that says what a chunk is about."""
    own = F.when(doc_type != "blog_faq", title)
    return (F.when(doc_type.isin("scheme_fact", "scheme_faq"), F.concat(
        F.lit("["), scheme_name, F.lit(" | "), label_map(section, P.SECTION_LABELS), F.lit("]")))
        .when(doc_type == "help_faq", F.lit(f"[{site} Help Centre: mutual funds FAQ]"))
        .otherwise(F.concat(F.lit(f"[{site} blog: "), heading_path(page_title, parent, own), F.lit("]"))))


def chunk_table(docs: DataFrame, header: Column, pieces: Column, keep: list[str]) -> DataFrame:
    """One row per chunk: id, context header with part label, inherited columns, number, count and size.

    ``pieces``: array<struct<text, n>> as of ``split_counted``; a chunk has the tokens of its header and of its piece.
    """
    label = F.when(F.col("n_chunks") == 1, F.col("_h")).otherwise(F.concat(
        F.expr("left(_h, length(_h) - 1)"), F.lit(" | part "), (F.col("chunk_index") + 1).cast("string"),
        F.lit(" of "), F.col("n_chunks").cast("string"), F.lit("]")))
    return (docs.select("id", *keep, header.alias("_h"), pieces.alias("_p"))
            .select("id", *keep, "_h", F.size("_p").alias("n_chunks"), F.posexplode("_p").alias("chunk_index", "_t"))
            .select("id", *keep, "n_chunks", "chunk_index", "_t", label.alias("_h"))
            .select(F.concat_ws("-", "id", F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("id").alias("doc_id"),
                    F.concat("_h", F.lit("\n"), strip(F.col("_t.text"))).alias("text"), *keep, "chunk_index", "n_chunks",
                    (token_count(F.col("_h")) + F.col("_t.n")).alias("tokens")))


def section_chunking(docs: DataFrame, section: str, text: str, config: dict[str, tuple[int, int]]) -> DataFrame:
    """Pieces of (size, overlap) characters for the sections that have a setting, cut at paragraphs, lines, words, then
    characters; the other sections pass whole."""
    def pieces(limits: Column) -> Column:
        return recursive_split(F.col(text), limits["size"], limits["lap"], PLAIN_BREAKS, r"(?s).", F.length)

    limits = F.create_map(*[x for k, (size, lap) in config.items() for x in (
        F.lit(k), F.struct(F.lit(size).alias("size"), F.lit(lap).alias("lap")))])
    sized = docs.withColumn("_limits", F.try_element_at(limits, F.col(section)))
    cut = F.when(F.col("_limits").isNull(), F.array(text)).otherwise(let(F.col("_limits"), pieces))
    return sized.withColumn("_w", cut).drop(text, "_limits").select("*", F.posexplode("_w").alias("chunk_index", text)).drop("_w")


def chunk_size_check(chunks: DataFrame, limit: int = P.CHUNK_MAX_TOKENS + P.CHUNK_SLACK_TOKENS) -> DataFrame:
    """Problem rows: chunks above the limit."""
    return chunks.where(F.col("tokens") > limit).select("chunk_id", "tokens")
