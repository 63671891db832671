"""Structure inside one text, found within the row: sections, FAQs, tables, key-value rows, profiles, articles.

Every function is a column expression on the whole text. Nothing here shuffles: a document's lines never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions.scalars import null_markers
from corpusmill.functions.text import clean_text, let, lines, rep, strip, unix_lines

HEADING_START = r"\n(?=#)"


def section_parts(c: Column) -> Column:
    """The raw sections, each from its heading on; text before the first one is dropped."""
    return F.filter(F.split(unix_lines(c), HEADING_START, -1), lambda s: s.startswith("#"))


def heading_line(s: Column) -> Column:
    return F.substring_index(s, "\n", 1)


def heading_of(s: Column) -> Column:
    return strip(rep(heading_line(s), r"^#{1,6}"))


def body_of(s: Column) -> Column:
    return strip(F.substr(s, F.length(heading_line(s)) + 2))


def split_sections(c: Column) -> Column:
    """array<struct<level, heading, body>> at every heading; text before the first one is dropped."""
    return F.transform(section_parts(c), lambda s: F.struct(
        F.length(F.regexp_extract(heading_line(s), r"^#{1,6}", 0)).alias("level"),
        heading_of(s).alias("heading"), body_of(s).alias("body")))


def explode_sections(df: DataFrame, key: str, text: Column) -> DataFrame:
    """One row per section with its 1-based number."""
    return df.select(key, F.posexplode(split_sections(text)).alias("pos", "s")).select(
        key, (F.col("pos") + 1).alias("section_id"), "s.level", "s.heading", "s.body")


def runs(items: Column, opens) -> Column:
    """array of arrays: the items before the first one that opens a run (maybe none), then each run. Each is one slice."""
    def cut(xs: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), F.filter(F.sequence(F.lit(1), F.size(xs)), lambda i: opens(F.element_at(xs, i))))
        return let(starts, lambda at: F.transform(at, lambda s, k: F.slice(
            xs, s, F.coalesce(F.try_element_at(at, k + 2), F.size(xs) + 1) - s)))

    return let(items, lambda xs: F.when(F.size(xs) > 0, cut(xs)))


def section_ids(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Every line with the running number of its section (0 before the first heading), numbered within the row."""
    numbered = F.flatten(F.transform(runs(lines(text), lambda x: x.rlike(r"^#")), lambda run, k: F.transform(
        run, lambda x: F.struct(x.alias("line"), k.cast("bigint").alias("section_id")))))
    return df.select(key, F.posexplode(numbered).alias("pos", "l")).select(key, "pos", "l.*")


def parent_headings(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Sections with the last heading of level two or less before them, carried within the row, and whether it opens the
    FAQs; sections of these levels have no parent."""
    def told(run: Column, k: Column) -> Column:
        top = F.when(k > 0, run[0]["heading"])
        faq = F.coalesce(F.lower(top).isin("faqs", "frequently asked questions"), F.lit(False))
        return F.transform(run, lambda s: F.struct(
            s["level"].alias("level"), s["heading"].alias("heading"), s["body"].alias("body"),
            F.when(s["level"] > 2, top).alias("parent_heading"), (faq & (s["level"] > 2)).alias("is_faq")))

    found = F.flatten(F.transform(runs(split_sections(text), lambda s: s["level"] <= 2), told))
    return df.select(key, F.posexplode(found).alias("pos", "s")).select(key, (F.col("pos") + 1).alias("section_id"), "s.*")


def first_body(parts: Column, matches) -> Column:
    """Body of the first raw section whose heading passes a test; NULL when none does. Only this body is taken out."""
    return let(F.try_element_at(F.filter(parts, lambda s: matches(heading_of(s))), F.lit(1)), body_of)


def position_of(flags: Column) -> Column:
    """1-based place of the first true flag, 0 when there is none."""
    return F.array_position(flags, True)


def tail_after(items: Column, at: Column) -> Column:
    """Items after a 1-based place, none when the place is 0."""
    return F.when(at > 0, F.slice(items, at + 1, F.size(items))).otherwise(F.slice(items, 1, 0))


def head_before(items: Column, at: Column) -> Column:
    """Items before a 1-based place, all when the place is 0."""
    return F.slice(items, F.lit(1), F.when(at > 0, at.cast("int") - 1).otherwise(F.size(items)))


def extract_faqs(c: Column) -> Column:
    """array<struct<question, answer>>: headings after ``FAQs`` up to the first one that is no question."""
    def faq(s: Column) -> Column:
        answer = F.split_part(s["body"], F.lit(P.PROMO_BANNER), F.lit(1))
        return F.struct(s["heading"].alias("question"), strip(rep(answer, r"(?U)\s*\n\s*", "\n")).alias("answer"))

    def block(secs: Column) -> Column:
        start = position_of(F.transform(secs, lambda s: F.lower(s["heading"]) == "faqs"))
        return let(tail_after(secs, start), lambda after: head_before(
            after, position_of(F.transform(after, lambda s: ~s["heading"].endswith("?")))))

    return F.filter(F.transform(let(split_sections(c), block), faq), lambda f: f["answer"] != "")


def cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|", -1), strip)


def table_body(c: Column, heading: str = "returns and rankings") -> Column:
    """Text of the first section whose heading contains a phrase."""
    return first_body(section_parts(c), lambda h: F.contains(F.lower(h), F.lit(heading)))


def unpivot_table(c: Column, heading: str = "returns and rankings") -> Column:
    """array<struct<metric, period, value>> of the pipe table under a heading; a repeated metric keeps its last row."""
    return unpivot_body(table_body(c, heading))


def unpivot_body(body: Column) -> Column:
    """The same from the text under the heading."""
    table = F.filter(lines(body), lambda line: F.contains(line, F.lit("|")))

    def parsed(rows: Column) -> Column:
        periods = F.slice(rows[0], F.lit(2), F.size(rows[0]))
        data = F.slice(rows, F.lit(3), F.size(rows))

        def row(r: Column) -> Column:
            values = F.slice(r, F.lit(2), F.least(F.size(periods), F.size(r) - 1))
            pairs = F.transform(values, lambda v, j: F.struct(
                r[0].alias("metric"), periods[j].alias("period"), null_markers(v).alias("value")))
            return F.filter(pairs, lambda z: z["period"] != "")

        # In order of metric and place, a metric's last row is the one before the next metric.
        ordered = F.array_sort(F.transform(data, lambda r, i: F.struct(r[0].alias("metric"), i.alias("at"))))
        last = let(ordered, lambda rows: F.filter(rows, lambda x, j: ~F.get(rows, j + 1)["metric"].eqNullSafe(x["metric"])))
        kept = F.array_sort(F.transform(last, lambda x: x["at"]))
        return F.when(F.size(rows) >= 3, F.flatten(F.transform(kept, lambda at: let(rows[at + 2], row))))

    return let(F.transform(table, cells), parsed)


def table_context(c: Column, heading: str = "returns and rankings") -> Column:
    """Category line and return-type lines shown above the table."""
    return context_of(table_body(c, heading))


def context_of(body: Column) -> Column:
    """The same from the text under the heading."""
    def context(above: Column) -> Column:
        types = F.filter(above, lambda x: F.lower(x).isin("annualised returns", "absolute returns"))
        category = F.try_element_at(F.filter(above, lambda x: F.lower(x).startswith("category:")), F.lit(1))
        return F.struct(strip(F.substr(category, F.lit(10))).alias("category"),
                        types.alias("available_types"), F.try_element_at(types, F.lit(1)).alias("active_type"))

    return let(F.transform(lines(body), strip), context)


def is_separator(line: Column) -> Column:
    return line.rlike(r"^-+\|")


def pipe_rows(c: Column, header: str = "name | sector | instrument | assets", width: int = 4) -> Column:
    """Rows with exactly ``width`` cells below a known header line, up to a blank line or the next section."""
    def region(ls: Column) -> Column:
        at = position_of(F.transform(ls, lambda x: F.lower(x).startswith(header)))
        return let(tail_after(ls, at), lambda after: head_before(
            after, position_of(F.transform(after, lambda x: (x == "") | x.startswith("## ")))))

    kept = F.filter(let(F.transform(lines(c), strip), region), lambda x: (
        F.contains(x, F.lit("|")) & ~is_separator(x) & ~F.lower(x).startswith(header)))
    return F.filter(F.transform(kept, cells), lambda r: F.size(r) == width)


def reported_count(c: Column, heading: str = "Holdings") -> Column:
    """The number a heading such as ``## Holdings (238)`` announces."""
    return F.nullif(F.regexp_extract(c, rf"(?iU)##\s*{heading}\s*\((\d+)\)", 1), F.lit("")).cast("int")


def heading_text(c: Column, heading: str) -> Column:
    """All text under a heading until the next heading."""
    return heading_body(section_parts(c), heading)


def heading_body(parts: Column, heading: str) -> Column:
    """The same from the raw sections."""
    return first_body(parts, lambda h: F.lower(h) == heading.lower())


def key_value_rows(c: Column, heading: str) -> Column:
    """array<struct<label, value>> of the ``label | value`` lines under a heading."""
    return key_values(heading_text(c, heading))


def key_values(body: Column) -> Column:
    """The same from the text under the heading."""
    ls = F.filter(F.transform(lines(body), strip),
                  lambda x: F.contains(x, F.lit("|")) & ~is_separator(x))
    return F.transform(F.transform(ls, cells), lambda r: F.struct(r[0].alias("label"), r[1].alias("value")))


def value_under(c: Column, label: str) -> Column:
    """First non-empty line after a label line."""
    return F.nullif(strip(F.regexp_extract(c, rf"(?iU){label}\s*\n+([^\n]+)", 1)), F.lit(""))


def profile_blocks(c: Column, heading: str = "fund management") -> Column:
    """array<struct<name, tenure, education, experience>> from the ``###`` blocks under a heading."""
    area = F.regexp_extract(unix_lines(c), rf"(?is)(?:\A|\n)[ \t]*## {heading}[^\n]*\n(.*?)(?:\n[ \t]*## |\z)", 1)
    blocks = F.filter(F.split(area, r"\n(?=[ \t]*###)", -1), lambda b: F.ltrim(b).startswith("###"))

    def marker(x: Column) -> Column:
        low = F.lower(x)
        return (low == "view details") | low.rlike("^(education|experience|also manages)")

    def grow(acc: Column, x: Column) -> Column:
        low = F.lower(x)
        mode = (F.when(low.startswith("education"), "edu").when(low.startswith("experience"), "exp")
                .when(low.startswith("also manages") | x.startswith("###"), "none"))
        take = mode.isNull() & (x != "")
        return F.struct(
            F.coalesce(mode, acc["mode"]).alias("mode"),
            F.when(take & (acc["mode"] == "edu"), F.concat(acc["edu"], F.array(x))).otherwise(acc["edu"]).alias("edu"),
            F.when(take & (acc["mode"] == "exp"), F.concat(acc["exp"], F.array(x))).otherwise(acc["exp"]).alias("exp"))

    empty = F.array().cast("array<string>")

    def profile(ls: Column) -> Column:
        rest = F.slice(ls, F.lit(2), F.size(ls))
        inline = F.nullif(rep(rep(ls[0], "^###"), "^[ #]+|[ #]+$"), F.lit(""))
        plain = F.filter(rest, lambda x: (x != "") & ~marker(x))
        body = F.aggregate(rest, F.struct(F.lit("none").alias("mode"), empty.alias("edu"), empty.alias("exp")), grow)
        return let(F.struct(inline.alias("inline"), plain.alias("plain"), body.alias("body")), named)

    def named(p: Column) -> Column:
        one, two = F.try_element_at(p["plain"], F.lit(1)), F.try_element_at(p["plain"], F.lit(2))
        return F.struct(
            F.coalesce(p["inline"], one).alias("name"),
            F.when(p["inline"].isNotNull(), one).otherwise(two).alias("tenure"),
            F.nullif(F.array_join(p["body"]["edu"], " "), F.lit("")).alias("education"),
            F.nullif(F.array_join(p["body"]["exp"], " "), F.lit("")).alias("experience"))

    parsed = F.transform(F.transform(blocks, lambda b: F.transform(F.split(b, "\n", -1), strip)), profile)
    return F.filter(parsed, lambda p: F.coalesce(
        p["name"], p["tenure"], p["education"], p["experience"]).isNotNull())


def help_article(md: Column) -> Column:
    """struct<question, answer, status>: status ``ok``, ``dead page`` (the source's fault) or ``failed`` (ours)."""
    last_h1 = r"(?s)\A(?:.*\n)?# ([^\n]+)(.*)\z"

    def article(page: Column) -> Column:
        dead = (F.regexp_count(page, F.lit(r"(?dm)^# (.+)$")) < 2) | F.contains(page, F.lit(P.ERROR_SCREEN))

        def with_rest(rest: Column) -> Column:
            return let(clean_text(F.substring_index(rest, P.ANSWER_END, 1)), lambda answer: F.struct(
                strip(F.regexp_extract(page, last_h1, 1)).alias("question"), answer.alias("answer"),
                F.when(dead, "dead page").when(~F.contains(rest, F.lit(P.ANSWER_END)), "failed")
                .when(answer == "", "dead page").otherwise("ok").alias("status")))

        return let(F.regexp_extract(page, last_h1, 2), with_rest)

    return let(md, article)


def blog_article(md: Column) -> Column:
    """struct<title, sections>; sections carry parent heading and FAQ flag. NULL when there is no article."""
    item = "struct<heading:string,parent:string,text:string,is_faq:boolean>"

    def grow(acc: Column, s: Column) -> Column:
        top = s["level"] <= 2
        parent = F.when(top, s["heading"]).otherwise(acc["parent"])
        faq = F.when(top, F.lower(s["heading"]).isin("faqs", "frequently asked questions")).otherwise(acc["in_faqs"])
        row = F.struct(s["heading"].alias("heading"), F.when(~top, parent).alias("parent"), s["body"].alias("text"),
                       (faq & ~top).alias("is_faq"))
        return F.struct(parent.alias("parent"), faq.alias("in_faqs"),
                        F.when(s["body"] != "", F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("parent"), F.lit(False).alias("in_faqs"),
                     F.array().cast(f"array<{item}>").alias("out"))

    def built(from_h1: Column) -> Column:
        article = F.split(from_h1, P.ARTICLE_END, 2)[0]
        title = clean_text(F.regexp_extract(from_h1, r"\A# ([^\n]+)", 1))
        cleaned = F.transform(split_sections(article), lambda s: F.struct(
            s["level"].alias("level"),
            strip(F.replace(clean_text(s["heading"]), F.lit("**"), F.lit(""))).alias("heading"),
            clean_text(s["body"]).alias("body")))
        return let(F.aggregate(cleaned, start, grow, lambda acc: acc["out"]), lambda found: F.when(
            (from_h1 != "") & (F.size(found) > 0), F.struct(title.alias("title"), found.alias("sections"))))

    return let(F.regexp_extract(md, r"(?s)(?:\A|\n)(# [^\n]+.*)\z", 1), built)


def regex_fields(c: Column, fields: dict[str, tuple[str, int, str]]) -> Column:
    """struct of fields, each from the first match of its pattern: name -> (pattern, group, kind).

    Kinds: ``text`` (empty without a match), ``nonempty`` (NULL then), ``line`` (white space folded), ``number`` (a double
    without thousands marks, NULL when it is none) and ``all`` (an array of all matches).
    """
    def field(pattern: str, group: int, kind: str) -> Column:
        if kind == "all":
            return F.regexp_extract_all(c, F.lit(pattern), group)
        found = F.regexp_extract(c, pattern, group)
        if kind == "number":
            return F.replace(found, F.lit(",")).try_cast("double")
        if kind == "line":
            return strip(rep(found, r"\s+", " "))
        return F.nullif(found, F.lit("")) if kind == "nonempty" else found

    return F.struct(*[field(*spec).alias(name) for name, spec in fields.items()])
