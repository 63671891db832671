"""Entity detection by whole-word aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions.text import alias_pattern, rep, strip
from corpusmill.session import materialize


def resolve_entities(text: Column, aliases: dict[str, list[str]], house: list[str], generic: list[str]) -> Column:
    """struct<ids, stripped> against a short fixed alias list.

    Matched aliases leave the text; house names and generic words leave only when something matched; an empty rest
    falls back to the text itself.
    """
    patterns = {key: alias_pattern(names) for key, names in aliases.items()}
    ids = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(key)) for key, p in patterns.items()]))
    stripped = text
    for p in patterns.values():
        stripped = rep(stripped, p, " ")  # a pattern that does not match changes nothing
    bare = rep(rep(stripped, alias_pattern(house), " "), alias_pattern(generic), " ")
    hit = text.rlike(alias_pattern([a for names in aliases.values() for a in names] + house))
    out = strip(rep(F.when(hit, bare).otherwise(stripped), r"(?U)\s+", " "))
    return F.struct(ids.alias("ids"), F.coalesce(F.nullif(out, F.lit("")), text).alias("stripped"))


def n_words(names: DataFrame, column: str) -> Column:
    """Words of the longest name, as a scalar."""
    return names.agg(F.max(F.size(F.regexp_extract_all(F.lower(column), F.lit(P.WORD), 0)))).scalar()


def word_ngrams(text: Column, longest: Column) -> Column:
    """Distinct runs of 1..longest consecutive words, lower-case, single spaces."""
    found = F.regexp_extract_all(F.lower(text), F.lit(P.WORD), 0)
    sizes = F.sequence(F.lit(1), F.least(F.coalesce(longest, F.lit(1)), F.greatest(F.size(found), F.lit(1))))
    runs = F.flatten(F.transform(sizes, lambda n: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(found) - n, F.lit(0))),
        lambda i: F.array_join(F.slice(found, i + 1, n), " "))))
    return F.array_distinct(runs)


def alias_index(aliases: DataFrame) -> DataFrame:
    """(entity_id, alias, n, head, run): aliases in lower case, their number of words, their first word or first two as the
    head under which they are found, and a hash of all their words."""
    found = F.regexp_extract_all(F.lower("alias"), F.lit(P.WORD), 0)
    rows = aliases.select("entity_id", F.lower("alias").alias("alias"), found.alias("w")).where(F.size("w") > 0)
    return rows.select("entity_id", "alias", F.size("w").alias("n"), F.array_join(F.slice("w", 1, 2), " ").alias("head"), F.xxhash64("w").alias("run"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(P.WORD), 0)


def pieces_of(text: Column) -> Column:
    """Words and what parts them."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{P.WORD}|{P.WORD.replace('[', '[^', 1)}"), 0)


def alias_runs(messages: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, n, run, said, around): runs of words of a message that may be an alias. A run is made only where its first words
    are the head of an alias, and only in the lengths that occur under that head.

    ``said`` is the run with what stands between its words, ``around`` the same with a word more on either side.
    """
    # Written, so that their size is known before messages are read: a short list is sent to all tasks, and no word is shuffled.
    heads = materialize(index.groupBy("head").agg(F.collect_set("n").alias("lengths")), "alias-heads")  # as many as aliases have lengths
    words = words_of(F.col(text))
    said = messages.where(F.col(text).isNotNull())

    def begins(word: Column, i: Column) -> Column:
        after = F.get("w", i + 1)
        return F.array(F.struct(i.alias("pos"), word.alias("head")), F.struct(i.alias("pos"), F.concat(word, F.lit(" "), after).alias("head")))

    starts = said.select(F.col(key).alias("_key"), words.alias("w")).select("_key", F.explode(F.flatten(F.transform("w", begins))).alias("s")).select("_key", "s.pos", "s.head")
    at = starts.join(heads, "head").select("_key", F.explode("lengths").alias("n"), "pos")
    at = at.groupBy("_key").agg(F.collect_set(F.struct("pos", "n")).alias("at"))  # within one message
    # The text travels to its places as it is, half as long as its pieces, and is taken apart behind the join.
    m = said.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(at, "_key").select(
        "_key", "at", words_of(F.col("_text")).alias("w"), pieces_of(F.col("_text")).alias("p"))
    # Words and what parts them take turns; a text may begin with either.
    m = m.withColumn("lead", F.when(F.size("w") == 0, 0).otherwise(F.when(F.get("p", F.lit(0)) == F.get("w", F.lit(0)), 0).otherwise(1)))

    def run(x: Column) -> Column:
        first = x["pos"] * 2 + F.col("lead") + 1
        before = F.greatest(first - 2, F.lit(1))
        return F.struct(x["pos"].alias("pos"), x["n"].alias("n"), F.xxhash64(F.slice("w", x["pos"] + 1, x["n"])).alias("run"),
                        F.array_join(F.slice("p", first, x["n"] * 2 - 1), "").alias("said"),
                        F.array_join(F.slice("p", before, first - before + x["n"] * 2 + 1), "").alias("around"))

    inside = F.filter("at", lambda x: x["pos"] + x["n"] <= F.size("w"))
    return m.select(F.col("_key").alias(key), F.explode(F.transform(inside, run)).alias("r")).select(key, "r.*")


def alias_hits(messages: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity_id, alias, pos, n): every place where an alias stands as a whole word, by its first word's number."""
    index = materialize(alias_index(aliases), "alias-index")  # read for its heads and for its runs
    quoted = rep(F.col("alias"), r"([^\p{L}\p{N}_ ])", r"\\$1")
    whole = F.regexp_like(F.col("around"), F.concat(F.lit(r"(?iU)\b"), quoted, F.lit(r"\b")))
    # An alias may begin or end with a mark, which is no part of the run.
    edged = F.col("alias").rlike(rf"^{P.WORD.replace('[', '[^', 1)}|{P.WORD.replace('[', '[^', 1)}$")
    return alias_runs(messages, index, key, text).join(index.drop("head"), ["run", "n"]).where(
        whole & ((F.col("said") == F.col("alias")) | edged)).select(key, "entity_id", "alias", "pos", "n")


def alias_spans(messages: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity_id, alias, pos, n): the hits of each entity that one pass over the message takes, the leftmost first and of
    several at one place the longest, none overlapping another of the same entity."""
    hits = alias_hits(messages, aliases, key, text).distinct()
    span = F.struct("pos", (-F.length("alias")).alias("shorter"), "alias", "n")
    listed = hits.groupBy(key, "entity_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # within one message
    taken = F.aggregate("spans", F.expr("array_repeat(spans[0], 0)"), lambda done, s: F.when(
        (F.size(done) == 0) | (F.element_at(done, -1)["pos"] + F.element_at(done, -1)["n"] <= s["pos"]), F.concat(done, F.array(s))).otherwise(done))
    return listed.select(key, "entity_id", F.explode(taken).alias("s")).select(key, "entity_id", "s.alias", "s.pos", "s.n")


def alias_match_join(messages: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity_id) for a table of aliases of any size and length.

    Aliases are looked up under their first words, so a message makes a run of words only where an alias begins; the alias
    itself must then stand there as a whole word, so punctuation inside it counts. Messages without text have no entity.
    """
    return alias_hits(messages, aliases, key, text).select(key, "entity_id").distinct()


def bind_alias_keys(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """Aliases keyed by a distinctive part of an entity id, bound to the first entity whose id holds that part."""
    parts = entities.withColumn("_longest", n_words(aliases, "alias_key")).select(
        "entity_id", F.explode(word_ngrams(F.col("entity_id"), F.col("_longest"))).alias("part"))
    bound = parts.groupBy("part").agg(F.min("entity_id").alias("entity_id"))
    keyed = aliases.withColumn("part", F.array_join(F.regexp_extract_all(F.lower("alias_key"), F.lit(P.WORD), 0), " "))
    return keyed.join(bound, "part").select("entity_id", "alias")


def strip_aliases(matches: DataFrame, messages: DataFrame, aliases: DataFrame, key: str, text: str,
                  house: list[str], generic: list[str]) -> DataFrame:
    """Query text without its matched aliases, for a table of aliases: longest alias first within each message."""
    names = matches.join(aliases, "entity_id").groupBy(key).agg(
        F.array_sort(F.collect_set(F.lower("alias")), lambda a, b: F.length(b) - F.length(a)).alias("_names"))
    joined = messages.join(names, key, "left")
    whole = lambda a: F.concat(
        F.lit(r"(?iU)\b"), rep(a, r"([^\p{L}\p{N}_ ])", r"\\$1"), F.lit(r"\b"))
    less = F.aggregate(F.coalesce("_names", F.array().cast("array<string>")), F.col(text),
                       lambda acc, a: F.regexp_replace(acc, whole(a), F.lit(" ")))
    hit = F.col("_names").isNotNull() | F.col(text).rlike(alias_pattern(house))
    bare = F.when(hit, rep(rep(less, alias_pattern(house), " "), alias_pattern(generic), " ")).otherwise(less)
    out = strip(rep(bare, r"(?U)\s+", " "))
    return joined.select(key, F.coalesce(F.nullif(out, F.lit("")), F.col(text)).alias("stripped"))
