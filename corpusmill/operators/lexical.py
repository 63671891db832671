"""Keyword search: corpus statistics and BM25 over term lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.operators.dense import retriever_rank
from corpusmill.session import materialize

SCORE_DIGITS = 9
# Scores are compared with bars this far below them, since sums of doubles depend on their order.
SLACK = 1e-8
# A query's first candidates come from its terms' best SEEDS * k documents.
SEEDS = 2
# Postings that all queries together meet, from which on bars are looked for; fewer are added up sooner than bars are found.
PRUNE_FROM = 20_000_000
# Documents of a term that one list holds, and most terms of more than one list.
SPREAD, SPREAD_TERMS = 100_000, 100_000


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(term, df, terms): documents per term, and under the NULL term the number of documents and their length in terms.

    One pass over the corpus, written out, since every statistic below reads it. ``docs``: id, terms.
    """
    each = docs.select(F.size("terms").alias("dl"), F.explode(F.concat(
        F.array(F.lit(None).cast("string")), F.array_distinct("terms"))).alias("term"))
    return materialize(each.groupBy("term").agg(
        F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("terms")), "corpus-counts")


def corpus_stats(counts: DataFrame, epsilon: float = P.BM25_EPSILON) -> DataFrame:
    """(term, df, idf): a negative idf becomes epsilon times the mean idf of the vocabulary."""
    n = counts.where("term IS NULL").select("df")
    raw = counts.where("term IS NOT NULL").withColumn(
        "raw", F.ln(n.scalar() - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    floor = raw.agg(F.avg("raw") * epsilon)
    return raw.select("term", "df", F.when(F.col("raw") < 0, floor.scalar()).otherwise(F.col("raw")).alias("idf"))


def mean_length(counts: DataFrame) -> DataFrame:
    """One row: mean document length in terms."""
    return counts.where("term IS NULL").select((F.col("terms") / F.col("df")).alias("avgdl"))


def postings(docs: DataFrame, vocabulary: DataFrame, avgdl: Column, k1: float, b: float) -> DataFrame:
    """(id, key, term, part), written out: what each term of ``vocabulary`` gives a document that holds it, before the term's weight.

    Only tokens of the vocabulary are shuffled, once, by document.
    """
    tokens = docs.select("id", (F.col("key") if "key" in docs.columns else F.lit(None)).cast("string").alias("key"),
                         F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(vocabulary, "term", "left_semi")
    counted = tokens.repartition("id").groupBy("id", "key", "dl", "term").agg(F.count("*").alias("f"))
    return materialize(counted.select("id", "key", "term", (F.col("f") * (k1 + 1) / (
        F.col("f") + k1 * (1 - b + b * F.col("dl") / avgdl))).alias("part")), "bm25-postings")


class Postings:
    """Postings with what bounds a term: its largest part, and in how many salted lists it lies.

    A term in more than SPREAD documents is dealt into lists of about that many, so no task meets all documents of a term that
    every document has. There are at most SPREAD_TERMS such terms; the limit rises with the postings beyond that.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows
        bounds = materialize(rows.groupBy("term").agg(F.max("part").alias("most"), F.count("*").alias("n")), "bm25-bounds")
        per = F.greatest(F.lit(float(SPREAD)), bounds.agg(F.sum("n") / SPREAD_TERMS).scalar())
        self.bounds = bounds.withColumn("lists", F.ceil(F.col("n") / per).cast("int"))

    def dealt(self, least: DataFrame | None = None) -> DataFrame:
        """Rows with their list. ``least`` (term, cut): of the terms that are spread, parts below the cut, and terms that are
        not listed, are left out."""
        hot = self.bounds.where("lists > 1").select("term", "lists")
        if least is not None:
            hot = hot.join(least, "term", "left")
        rows = self.rows.join(F.broadcast(hot), "term", "left")  # at most SPREAD_TERMS rows
        if least is not None:
            rows = rows.where("lists IS NULL OR part >= cut")
        return rows.withColumn("list", F.coalesce(F.pmod(F.xxhash64("id"), F.col("lists")), F.lit(0)).cast("int"))


def every_list(rows: DataFrame) -> DataFrame:
    """Rows of (term, lists, ...) once for each list of the term."""
    return rows.withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)))


def term_bounds(asked: DataFrame, found: Postings, k: int) -> DataFrame:
    """Terms of the queries that some document holds, rare ones first, written out. ``bound``: the most a term gives a document;
    ``rest``: the most that all later terms give together; ``seed``: whether the term's best documents count among the query's
    first candidates. Windows run over the terms of one query."""
    rows = asked.join(found.bounds, "term").withColumn("bound", F.greatest("weight", F.lit(0.0)) * F.col("most"))
    order = W.partitionBy("qid").orderBy("n", "term")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    held = F.coalesce(F.sum(F.least("n", F.lit(SEEDS * k))).over(before), F.lit(0))
    # Rare terms may stand in the same few documents; one list of k makes sure that there are k candidates.
    first_long = (F.col("n") >= k) & (F.coalesce(F.max("n").over(before), F.lit(0)) < k)
    # No bar pays where looking up its candidates takes longer than meeting the documents of all terms.
    query = W.partitionBy("qid")
    worth = F.sum("n").over(query) > (2 * SEEDS + 1) * k * F.count("*").over(query)
    return materialize(rows.withColumns({"rest": F.coalesce(F.sum("bound").over(after), F.lit(0.0)),
                                         "seed": worth & ((held < SEEDS * k) | first_long)}), "bm25-terms")


def exact_scores(pairs: DataFrame, terms: DataFrame, found: Postings) -> DataFrame:
    """(qid, id, score) of distinct ``pairs`` (qid, id): each looks its query's terms up among the postings of its document."""
    looked = pairs.join(terms.select("qid", "term", "weight"), "qid").join(found.rows.select("id", "term", "part"), ["id", "term"])
    return looked.groupBy("id", "qid").agg(F.round(F.sum(F.col("weight") * F.col("part")), SCORE_DIGITS).alias("score")).where("score > 0")


def group_of(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("+"), key), F.lit("-"))


def first_bars(terms: DataFrame, found: Postings, k: int) -> DataFrame:
    """(qid, bar): the k-th best score among the best documents of each query's seed terms that it may see. Queries
    with fewer than k such documents have no bar."""
    groups = F.when(F.size("scope") == 0, F.array(F.lit("*"))).otherwise(
        F.concat(F.transform("scope", lambda s: group_of(s)), F.array(F.lit("-"))))
    wanted = terms.where("seed").select("qid", "term", "lists", F.explode(F.array_distinct(groups)).alias("grp"))
    lists = every_list(wanted.select("term", "lists", "grp").distinct()).drop("lists")
    shown = found.dealt().select("id", "term", "part", "list", F.explode(F.array(F.lit("*"), group_of(F.col("key")))).alias("grp"))
    best = shown.join(lists, ["term", "list", "grp"])
    for keys in (["term", "grp", "list"], ["term", "grp"]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("part"), "id"))
        best = best.withColumn("place", place).where(F.col("place") <= SEEDS * k)
    seeds = wanted.join(best, ["term", "grp"]).select("qid", "id").distinct()
    ranked = retriever_rank(exact_scores(seeds, terms, found), "score", "id", k)
    return ranked.where(F.col("rank") == k).select("qid", F.col("score").alias("bar"))


def with_bars(terms: DataFrame, bars: DataFrame) -> DataFrame:
    """Terms of the queries with their bar, and whether the query is ``pruned``.

    ``weak``: what a term gives at most where its posting is not strong, or not there. A pruned query meets the documents of
    its strong terms and looks up its other terms for those; it is pruned only where that is less work, even if every such
    document had to be looked up, than to meet the documents of all its terms.
    """
    query = W.partitionBy("qid")
    rows = terms.join(bars, "qid", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)) - SLACK)
    strong = F.col("bound") + F.col("rest") >= F.col("bar")
    met = F.sum(F.when(F.col("strong"), F.col("n")).otherwise(0)).over(query)
    return (rows.withColumns({"strong": strong, "weak": F.least("bound", F.greatest(F.col("bar") - F.col("rest"), F.lit(0.0)))})
            .withColumns({"pruned": met * (1 + F.count("*").over(query)) < F.sum("n").over(query), "all_weak": F.sum("weak").over(query)}))


def met(rows: DataFrame, found: Postings, pruned: bool) -> DataFrame:
    """Postings of the terms ``rows`` (qid, scope, term, lists, weight, ...) that the query may see, with all of its columns."""
    least = None
    if pruned:
        cut = F.when(F.col("weight") > 0, (F.col("bar") - F.col("rest")) / F.col("weight")).otherwise(F.lit(float("-inf")))
        least = rows.where("lists > 1").groupBy("term").agg((F.min(cut) - SLACK).alias("cut"))
    seen = (F.size("scope") == 0) | F.col("key").isNull() | F.array_contains("scope", F.col("key"))
    return found.dealt(least).drop("lists").join(every_list(rows).drop("n", "most", "lists"), ["term", "list"]).where(seen).withColumn(
        "given", F.col("weight") * F.col("part"))


def added_up(rows: DataFrame, found: Postings) -> DataFrame:
    """(qid, id, score) of every document that some term of ``rows`` is in."""
    return met(rows, found, False).groupBy("id", "qid").agg(F.round(F.sum("given"), SCORE_DIGITS).alias("score")).where("score > 0")


def contenders(rows: DataFrame, found: Postings) -> DataFrame:
    """(qid, id) of every document that may still reach the bar of a pruned query.

    Judged by its rarest term, a document can at most add what all later terms give. So a posting makes a candidate only if
    its own part and the rest reach the bar, and a term whose largest part doesn't is not met with its documents at all.
    A candidate stays while its strong parts, and for every other term the most that is left to it, reach the bar.
    """
    strong = met(rows.where("pruned AND strong"), found, True).where("given + rest >= bar")
    reach = strong.groupBy("qid", "id").agg((F.sum(F.col("given") - F.col("weak")) + F.first("all_weak") - F.first("bar")).alias("over"))
    return reach.where("over >= 0").select("qid", "id")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, counts: DataFrame | None = None,
              k1: float = P.BM25_K1, b: float = P.BM25_B) -> DataFrame:
    """(qid, id, score, rank): exact BM25 top k among documents that share a term, ties by id.

    ``queries``: qid, terms (repeats count) and optionally scope. ``docs``: id, terms and optionally key.
    Statistics are those of the whole corpus, whatever the scope.

    Scores are bounded before they are added up: the best documents of rare terms set a bar for each query, and a frequent
    term's documents are met only where its part and what is left can pass that bar. Who passes is scored exactly. Queries
    whose bar rules out too little, and all queries where they meet PRUNE_FROM postings at most, add up the postings of all
    their terms: the same hits either way. A term of very many documents is spread over tasks.
    """
    counts = corpus_counts(docs) if counts is None else counts
    asked = queries.select("qid", (F.col("scope") if "scope" in queries.columns else F.array()).cast("array<string>").alias("scope"),
                           F.explode("terms").alias("term")).groupBy("qid", "scope", "term").agg(F.count("*").alias("mult"))
    weights = asked.join(corpus_stats(counts), "term").select("term", "qid", "scope", (F.col("mult") * F.col("idf")).alias("weight"))
    # Written, so that its size is known before the corpus is read: few terms are sent to all tasks, and no token is shuffled to be dropped.
    vocabulary = materialize(asked.select("term").distinct(), "bm25-vocabulary")
    found = Postings(postings(docs, vocabulary, mean_length(counts).scalar(), k1, b))
    asked = weights.join(found.bounds, "term")
    if (asked.agg(F.sum("n")).head()[0] or 0) <= PRUNE_FROM:
        return retriever_rank(added_up(asked, found), "score", "id", k).select("qid", "id", "score", "rank")
    terms = term_bounds(weights, found, k)
    rows = materialize(with_bars(terms, first_bars(terms, found, k)), "bm25-bars")
    scored = added_up(rows.where("NOT pruned"), found).unionByName(exact_scores(contenders(rows, found), rows, found))
    return retriever_rank(scored, "score", "id", k).select("qid", "id", "score", "rank")


def name_match_topk(queries: DataFrame, names: DataFrame, single_intents: list[str] | None = None,
                    k: int = 3) -> DataFrame:
    """Entities whose name fits a question best: all when it says so, one for single-entity intents, else top k.

    ``queries``: qid, text, intent. ``names``: id, name. "All" questions name every entity by meaning; they come back
    as one row with NULL id, to be read as the whole list, so no question is multiplied by the entity table.
    """
    single = P.SINGLE_ENTITY_INTENTS if single_intents is None else single_intents
    everyone = F.contains("text", F.lit("all")) | F.contains("text", F.lit("schemes"))
    split = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    docs = names.select("id", split(F.col("name")).alias("terms"))
    ranked = bm25_topk(queries.where(~everyone).select("qid", split(F.col("text")).alias("terms")), docs, k)
    kept = ranked.join(queries.select("qid", "intent"), "qid").where(
        (F.col("rank") == 1) | ~F.col("intent").isin(*single)).select("qid", "id", "rank")
    return kept.unionByName(queries.where(everyone).select(
        "qid", F.lit(None).cast(names.schema["id"].dataType).alias("id"), F.lit(0).alias("rank")))
