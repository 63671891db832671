"""Routing rules and answer assembly over tables of messages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import templates as X
from corpusmill.functions.screening import finalize_answer, has_old_pii, has_pii, refusal_kind
from corpusmill.functions.text import extract_numbers, let, strip
from corpusmill.operators import facts as fact_ops, fusion
from corpusmill.session import materialize

# Answers for so many lists of fields, each of a few KB at most, are sent to all tasks.
FEW_LISTS = 4_096
REFUSALS = ("refuse_advice", "refuse_comparison")


@dataclass
class House:
    """Names and links the fixed texts need."""

    house: str = "the fund house's"
    site: str = "the site"
    example: str = "tax saver"
    schemes: str = "the listed schemes"
    links: dict[str, str] = field(default_factory=lambda: {
        "help": "https://example.com/help", "guide": "https://example.com/guide", "list": "https://example.com/list"})

    def text(self, template: str) -> str:
        return template.format(house=self.house, site=self.site, example=self.example, schemes=self.schemes)

    def safe(self) -> tuple[str, str]:
        text, link = X.SAFE_FALLBACK
        return self.text(text), self.links[link]


def finalized(house: House, body: Column, url: Column, date: Column) -> Column:
    return finalize_answer(body, url, date, *house.safe())


# ---- routing ----

#: Stands in ``scheme_ids`` for every scheme there is; a question never carries the list of all.
EVERY = "*"


def asks_every(ids: Column | str) -> Column:
    return F.array_contains(ids, EVERY)


def route_decision(df: DataFrame) -> DataFrame:
    """Add ``handler`` (and the mark ``EVERY`` where all schemes were asked for) from a classified intent.

    ``df``: intent, fact_fields, all_schemes, scheme_ids.
    """
    fact = F.col("intent") == "FACT"
    named = F.size("scheme_ids") > 0
    ids = F.when(fact & F.col("all_schemes") & ~named, F.array(F.lit(EVERY))).otherwise(F.col("scheme_ids"))
    others = F.create_map(*[F.lit(x) for kv in P.INTENT_HANDLERS.items() for x in kv])
    handler = (F.when(fact & (F.size("fact_fields") <= 0), "retrieval").when(fact & (F.size("scheme_ids") <= 0), "ask_scheme")
               .when(fact, "sql_fact").otherwise(F.try_element_at(others, F.col("intent"))))
    return df.withColumn("scheme_ids", ids).withColumn("handler", handler)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def merge_fact_routes(routes: Column) -> Column:
    """Fold fact parts over the same schemes or the same fields into the first such part; the order of parts counts.

    ``routes``: array<struct<question, handler, scheme_ids, fact_fields>>, at most a few per message.
    """
    def joins(m: Column, r: Column) -> Column:
        return (m["handler"] == "sql_fact") & (r["handler"] == "sql_fact") & (
            same_set(m["scheme_ids"], r["scheme_ids"]) | same_set(m["fact_fields"], r["fact_fields"]))

    def added(a: Column, b: Column) -> Column:
        return F.concat(a, F.filter(b, lambda x: ~F.array_contains(a, x)))

    def both(m: Column, r: Column) -> Column:
        return F.struct(F.concat_ws(" ", m["question"], r["question"]).alias("question"), m["handler"].alias("handler"),
                        added(m["scheme_ids"], r["scheme_ids"]).alias("scheme_ids"),
                        added(m["fact_fields"], r["fact_fields"]).alias("fact_fields"))

    def grow(acc: Column, r: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda m: joins(m, r)), True)
        return F.when(at == 0, F.concat(acc, F.array(r))).otherwise(
            F.transform(acc, lambda m, i: F.when(i + 1 == at, both(m, r)).otherwise(m)))

    kind = "array<struct<question:string,handler:string,scheme_ids:array<string>,fact_fields:array<string>>>"
    return F.aggregate(routes.cast(kind), F.array().cast(kind), grow)


def message_plan(routes: Column, whole: Column) -> Column:
    """struct<refusal, routes> of one message.

    A refused part refuses the message, advice before comparison; fact parts merge; parts that all need retrieval
    become the ``whole`` message's own route; pleasantries beside a real part fall away.
    """
    handlers = F.transform(routes, lambda r: r["handler"])
    refusal = F.when(F.array_contains(handlers, "refuse_advice"), "refuse_advice").when(
        F.array_contains(handlers, "refuse_comparison"), "refuse_comparison")

    def settled(merged: Column) -> Column:
        many = F.size(merged) > 1
        real = F.filter(merged, lambda r: r["handler"] != "small_talk")
        return (F.when(many & F.forall(merged, lambda r: r["handler"] == "retrieval"), F.array(whole))
                .when(many & (F.size(real) > 0), real).when(many, F.slice(merged, 1, 1)).otherwise(merged))

    return F.struct(refusal.alias("refusal"), F.when(refusal.isNull(), let(merge_fact_routes(routes), settled)).alias("routes"))


# ---- answers ----

def ungrounded_numbers(answer: Column, sources: Column) -> Column:
    return F.array_except(extract_numbers(answer), F.flatten(F.transform(sources, extract_numbers)))


def grounding_check(found: Column, answer: Column, source_id: Column, sources: Column) -> Column:
    """True when the answer may be shown: found, not blank, citing one of its sources, every number in a source."""
    valid = F.coalesce(source_id.between(1, F.size(sources)), F.lit(False))
    return F.coalesce(found, F.lit(False)) & (F.coalesce(strip(answer), F.lit("")) != "") & valid & (
        F.size(ungrounded_numbers(answer, sources)) == 0)


def assemble_answers(pairs: DataFrame, house: House) -> DataFrame:
    """Fact sentences of a request to one answer: a paragraph for one scheme, bullets for several.

    ``pairs`` is the result of fields_cross. A group holds one request's own scheme-field pairs.
    """
    grouped = pairs.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("scheme_pos", "field_pos", "sentence"))).alias("s"),
        (F.min("scheme_id") == F.max("scheme_id")).alias("one"), F.min_by("source_url", F.struct("scheme_pos", "field_pos")).alias("url"),
        F.max("scraped_at").alias("updated"))
    one = F.col("one")
    texts = F.transform("s", lambda x: x["sentence"])
    body = F.when(one, F.array_join(texts, " ")).otherwise(F.array_join(F.transform(texts, lambda x: F.concat(F.lit("- "), x)), "\n"))
    url = F.when(one, F.col("url")).otherwise(F.lit(house.links["list"]))
    return grouped.select("qid", finalized(house, body, url, F.col("updated")).alias("a")).select("qid", "a.*")


def answer_every_scheme(requests: DataFrame, facts: DataFrame, house: House) -> DataFrame:
    """Answers to questions about all schemes: one for each list of fields, however many questions ask it.

    ``requests``: qid, fact_fields. Facts are read once and cut to the few that a reply shows before any shuffle.
    """
    asked = requests.select("qid", "fact_fields", F.to_json("fact_fields").alias("_list"))
    lists = asked.select(F.col("_list").alias("qid"), "fact_fields").distinct()
    told = materialize(assemble_answers(fact_ops.every_cross(lists, facts, P.MAX_LIST_ITEMS), house).withColumnRenamed("qid", "_list"), "list-answers")
    # Few lists are asked by very many: dealt by list, all that ask one would meet in one task.
    few = told.count() <= FEW_LISTS
    return asked.select("qid", "_list").join(F.broadcast(told) if few else told, "_list").drop("_list")


def format_rows(rows: Column, footer: Column) -> Column:
    """The older answer text over result rows, array<struct<name, value, extra>>."""
    line = lambda r: F.concat(F.lit("- "), r["name"], F.lit(": "), r["value"], F.coalesce(
        F.concat(F.lit(" ("), r["extra"], F.lit(")")), F.lit("")))
    single = (F.size(rows) == 1) & rows[0]["extra"].isNull()
    return F.concat(
        F.when(F.size(rows) <= 0, F.lit(X.OLD_NO_ROWS))
        .when(single, X.fill(X.OLD_ONE_ROW, name=F.try_element_at(rows, F.lit(1))["name"], value=F.try_element_at(rows, F.lit(1))["value"]))
        .otherwise(F.concat(F.lit(X.OLD_LIST), F.array_join(F.transform(rows, line), "\n"))), footer)


def structured_or_retrieved(questions: DataFrame, rows: DataFrame, retrieved: DataFrame, house: House, footer: Column) -> DataFrame:
    """(qid, route, text): the older chain, a table answer where intent and schemes allow one, else the retrieval answer.

    ``questions``: qid, message, intent, scheme_ids. ``rows``: scheme_id, intent, pos, name, value, extra. ``retrieved``: qid,
    text. Personal data in the message stops it. A group holds the rows of one question's own schemes.
    """
    looked_up = F.col("intent").isin(*P.STRUCTURED_INTENTS) & (F.size("scheme_ids") > 0)
    route = F.when(has_old_pii(F.col("message")), "pii").when(looked_up, "structured").otherwise("retrieval")
    routed = questions.select("qid", "intent", "scheme_ids", route.alias("route"))
    asked = routed.where("route = 'structured'").select("qid", "intent", F.posexplode("scheme_ids").alias("scheme_pos", "scheme_id"))
    found = asked.join(rows, ["scheme_id", "intent"]).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("scheme_pos", "pos", "name", "value", "extra"))).alias("rows"))
    told = F.coalesce("rows", F.slice(F.array(F.struct(F.lit(0).alias("scheme_pos"), F.lit(0).alias("pos"), *[
        F.lit(None).cast("string").alias(c) for c in ("name", "value", "extra")])), 1, 0))
    first = F.try_element_at(F.col("rows"), F.lit(1))
    nav = F.concat(X.fill(X.OLD_NAV, name=first["name"], value=first["value"], extra=first["extra"]), footer)
    structured = F.when((F.col("intent") == "NAV") & F.col("rows").isNotNull(), nav).otherwise(format_rows(told, footer))
    refusal = X.OLD_PII_REPLY.format(house=house.house, site=house.site, link=house.links["list"])
    return routed.join(found, "qid", "left").join(retrieved.select("qid", F.col("text").alias("_said")), "qid", "left").select(
        "qid", "route", F.when(F.col("route") == "pii", refusal).when(F.col("route") == "structured", structured)
        .otherwise(F.col("_said")).alias("text"))


def combine_parts(parts: Column) -> Column:
    """One reply from several parts: repeated texts once, bodies joined, first citation, newest date.

    ``parts``: array<struct<text, body, citation_url, last_updated>>.
    """
    def combined(kept: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(kept, lambda p: p["text"]), "\n\n").alias("text"),
            F.array_join(F.transform(kept, lambda p: p["body"]), "\n\n").alias("body"),
            F.try_element_at(kept, F.lit(1))["citation_url"].alias("citation_url"),
            F.array_max(F.transform(kept, lambda p: F.nullif(p["last_updated"], F.lit("")))).alias("last_updated"))

    first = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, F.lit(1), i), lambda q: q["text"] == p["text"]))
    return let(let(parts, first), combined)


def passages(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with the columns of ``texts`` (id and others). Only texts that are hit leave their scan: hits and their ids are
    written first, so that their sizes are known before any text is dealt out."""
    found = materialize(hits, "passage-hits")
    ids = materialize(found.select("id").distinct(), "passage-ids")
    return found.join(texts.join(ids, "id", "left_semi"), "id")


def format_context(hits: DataFrame, text: str) -> DataFrame:
    """Hits of a query, numbered and joined; a query has at most its k hits."""
    lines = F.array_sort(F.collect_list(F.struct("rank", text)))
    return hits.groupBy("qid").agg(lines.alias("h")).select("qid", F.array_join(F.transform("h", lambda x: F.concat(
        F.lit("["), x["rank"].cast("string"), F.lit("] "), x[text])), "\n\n").alias("context"))


def reply_table(spark: SparkSession, house: House) -> DataFrame:
    """The fixed replies, finalized once: seven rows."""
    rows = [(k, house.text(text), house.links[link]) for k, (text, link) in X.FIXED_REPLIES.items()]
    raw = spark.createDataFrame(rows, "handler string, body string, url string")
    out = finalized(house, F.col("body"), F.col("url"), F.lit(None).cast("string"))
    return raw.select("handler", out.alias("a")).select("handler", "a.*")


def fixed_reply(df: DataFrame, house: House) -> DataFrame:
    return df.join(F.broadcast(reply_table(df.sparkSession, house)), "handler")


REPLY_COLUMNS = ["qid", "handler", "text", "body", "citation_url", "last_updated"]


def batch_answer(questions: DataFrame, facts: DataFrame, chunks: DataFrame, house: House,
                 k: int = P.RETRIEVAL_K, house_names: list[str] | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(qid, handler, text, body, citation_url, last_updated): one reply per question of one part.

    ``questions``: qid, message, intent, fact_fields, all_schemes, scheme_ids, qvec and the model's output for the
    retrieved passages (found, answer, source_id). ``chunks``: id, terms, vec, key, text, source_url, scraped_at; or ``texts``
    has all of these but vec, so that no text goes through the join that gives chunks their vectors.
    Screened messages never reach a lookup or a search.
    """
    routed = route_decision(questions).withColumn("handler", F.coalesce(
        F.when(has_pii(F.col("message")), "pii"), refusal_kind(F.col("message"), house_names), F.col("handler")))
    return answer_routed(materialize(routed.select(
        "qid", "handler", "message", "scheme_ids", "fact_fields", "qvec", "found", "answer", "source_id"), "routed"), facts, chunks, house, k, texts)


def answer_routed(routed: DataFrame, facts: DataFrame, chunks: DataFrame, house: House, k: int = P.RETRIEVAL_K,
                  texts: DataFrame | None = None) -> DataFrame:
    """Replies to routed questions. ``routed`` is read by every branch, so it should be a written table: qid, handler,
    message, scheme_ids, fact_fields, qvec, found, answer, source_id."""
    asked = routed.where("handler = 'sql_fact'").select("qid", "scheme_ids", "fact_fields")
    named = assemble_answers(fact_ops.fields_cross(asked.where(~asks_every("scheme_ids")), facts), house)
    told = named.unionByName(answer_every_scheme(asked.where(asks_every("scheme_ids")), facts, house))
    answered = materialize(told.withColumn("handler", F.lit("sql_fact")).select(*REPLY_COLUMNS), "fact-answers")
    no_fact = asked.join(answered, "qid", "left_anti").select("qid", F.lit("not_found").alias("handler"))

    search = routed.where("handler = 'retrieval'").select(
        "qid", F.col("message").alias("text"), F.col("message").alias("stripped"),
        F.filter("scheme_ids", lambda i: i != EVERY).alias("scope"), "qvec")
    texts = chunks if texts is None else texts
    hits = materialize(fusion.hybrid_retrieve(search, chunks.select("id", "vec", "key"), k, texts=texts.select("id", "terms", "key")).select(
        "qid", "id", "rank", "best_cosine"), "hits")
    # Passages of the few hits only: their ids meet the text column at its scan.
    told = hits.join(texts.select("id", F.col("text").alias("passage"), "source_url", "scraped_at"), "id")
    ranked = told.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "passage", "source_url", "scraped_at"))).alias("hits"),
        F.max("best_cosine").alias("best"))
    judged = routed.where("handler = 'retrieval'").select("qid", "found", "answer", "source_id").join(ranked, "qid", "left")
    passages = F.coalesce(F.transform("hits", lambda h: h["passage"]), F.array().cast("array<string>"))
    fine = F.coalesce(F.col("best") >= P.MIN_DENSE_COSINE, F.lit(False)) & grounding_check(
        F.col("found"), F.col("answer"), F.col("source_id"), passages)
    checked = materialize(judged.withColumn("fine", fine), "checked-answers")  # read by both outcomes below
    source = F.try_element_at(F.col("hits"), F.col("source_id"))
    explained = checked.where("fine").select("qid", finalized(
        house, strip(F.col("answer")), source["source_url"], F.left(source["scraped_at"], F.lit(10))).alias("a")).select(
        "qid", F.lit("retrieval").alias("handler"), *[f"a.{c}" for c in REPLY_COLUMNS[2:]])
    no_text = checked.where("NOT fine").select("qid", F.lit("not_found").alias("handler"))

    fixed = routed.where(~F.col("handler").isin("sql_fact", "retrieval")).select("qid", "handler")
    said = fixed_reply(fixed.unionByName(no_fact).unionByName(no_text), house).select(*REPLY_COLUMNS)
    return answered.unionByName(explained).unionByName(said)


def answer_messages(messages: DataFrame, model: DataFrame, facts: DataFrame, chunks: DataFrame, house: House,
                    k: int = P.RETRIEVAL_K, house_names: list[str] | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(qid, handler, text, body, citation_url, last_updated): one reply per message, which may ask several things.

    ``messages``: qid, message, standalone (the message with what it refers to spelled out), parts and whole. ``parts`` is
    an array of struct<question, intent, fact_fields, all_schemes, scheme_ids> in order, a few per message, and ``whole``
    the same of the standalone text. ``model``: qid, question, qvec, found, answer, source_id for the questions that may be
    looked up. Personal data in the message stops it, then advice or comparison in either text, then a part that asks for
    either. Fact parts merge, parts that all need passages are asked as one, and several replies become one (``multi``). ``texts``: as of ``batch_answer``.
    """
    stop = F.coalesce(F.when(has_pii(F.col("message")), "pii"), refusal_kind(F.col("message"), house_names),
                      refusal_kind(F.col("standalone"), house_names))
    screened = messages.withColumn("stop", stop)
    each = screened.where("stop IS NULL").select("qid", F.posexplode(F.array_append("parts", F.col("whole"))).alias("no", "p"),
                                                 F.size("parts").alias("n")).select("qid", "no", "n", "p.*")
    route = F.struct("question", "handler", "scheme_ids", "fact_fields")
    routes = route_decision(each).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("no", (F.col("no") == F.col("n")).alias("is_whole"), route.alias("r")))).alias("all"))
    one = lambda flag: F.transform(F.filter("all", lambda x: x["is_whole"] == flag), lambda x: x["r"])
    planned = routes.select("qid", message_plan(one(F.lit(False)), one(F.lit(True))[0]).alias("plan"))
    planned = materialize(planned.select("qid", "plan.*"), "message-plans")

    asked = planned.where("refusal IS NULL").select("qid", F.posexplode("routes").alias("no", "r")).select(
        "qid", "no", "r.*").join(model, ["qid", "question"], "left")
    # Parts get ids of their own; the table is written once, so every reader sees the same ones.
    routed = materialize(asked.select(F.monotonically_increasing_id().alias("part"), "*"), "routed")
    replies = answer_routed(routed.select(
        F.col("part").alias("qid"), "handler", F.col("question").alias("message"), "scheme_ids", "fact_fields", "qvec", "found", "answer",
        "source_id"), facts, chunks, house, k, texts).withColumnRenamed("qid", "part")
    replies = replies.join(routed.select("part", "qid", "no"), "part")
    reply = F.struct("no", "handler", *REPLY_COLUMNS[2:])
    grouped = replies.groupBy("qid").agg(F.array_sort(F.collect_list(reply)).alias("ps"))
    shown = F.transform("ps", lambda p: F.struct(*[p[c].alias(c) for c in ("text", "body", "citation_url", "last_updated")]))
    many = F.size("ps") > 1
    answered = grouped.select("qid", F.when(many, "multi").otherwise(F.col("ps")[0]["handler"]).alias("handler"),
                              F.when(many, combine_parts(shown)).otherwise(shown[0]).alias("a")).select("qid", "handler", "a.*")
    stopped = screened.where("stop IS NOT NULL").select("qid", F.col("stop").alias("handler")).unionByName(
        planned.where("refusal IS NOT NULL").select("qid", F.col("refusal").alias("handler")))
    return answered.select(*REPLY_COLUMNS).unionByName(fixed_reply(stopped, house).select(*REPLY_COLUMNS))
