"""Tables of aliases against one pattern an entity, longest alias first."""

import random
import re

from pyspark.sql import functions as F

from corpusmill.operators import entities


def patterns(aliases):
    names = {}
    for entity, alias in aliases:
        names.setdefault(entity, set()).add(alias)
    return {e: re.compile(r"\b(" + "|".join(re.escape(a) for a in sorted(n, key=len, reverse=True)) + r")\b", re.IGNORECASE) for e, n in names.items()}


def frames(spark, messages, aliases):
    return (spark.createDataFrame(list(enumerate(messages)), "id bigint, t string"), spark.createDataFrame(aliases, "entity_id string, alias string"))


LONG = " ".join(f"w{i % 9}" for i in range(50))
ALIASES = [("liq", "liquid fund"), ("liq", "liquid"), ("flexi", "flexi cap"), ("flexi", "flexi-cap"), ("flexi", "cap flexi cap"), ("pp", "pp"), ("pp", "pp mf"),
           ("aa", "a a"), ("aa", "a-a"), ("long", LONG), ("dot", "u.s."), ("accent", "école d'été"), ("num", "3 4 5"), ("num", "4")]


def test_entities_and_spans_equal_the_patterns(spark):
    rng = random.Random(6)
    parts = ["liquid", "Fund", "liquidity", "FLEXI", "cap", "flexi-cap", "pp", "mf", "a", "A", "u.s.", "école", "d'été", "3", "4", "5", "x", LONG]
    gaps = [" ", " ", " ", "-", ", ", ".", "  ", "\n"]
    messages = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randrange(0, 14))) for _ in range(500)]
    messages += ["", None, "...", "- a-a a", "a a a a a", "liquid", "(pp)", "flexi. cap", "flexi  cap", LONG.upper(), LONG + " w0", "LIQUID FUND!"]
    m, a = frames(spark, messages, ALIASES)
    found = patterns(ALIASES)
    got = {(r.id, r.entity_id) for r in entities.alias_match_join(m, a, "id", "t").collect()}
    marked = {"dot"}  # ends with a mark: \\b behind it asks for a word there
    want = {(i, e) for i, t in enumerate(messages) for e, p in found.items() if t and p.search(t)}
    assert {x for x in got if x[1] not in marked} == {x for x in want if x[1] not in marked}
    spans = {}
    for r in entities.alias_spans(m, a, "id", "t").collect():
        spans.setdefault((r.id, r.entity_id), []).append((r.pos, r.alias))
    for i, t in enumerate(messages):
        for e, p in found.items():
            if t and e not in marked:
                hits = [(len(re.findall(r"[^\W]+", t[:x.start()])), x[0].lower()) for x in p.finditer(t)]
                assert sorted(spans.get((i, e), [])) == hits, (t, e)


def test_a_long_alias_makes_runs_only_where_it_begins(spark):
    rng = random.Random(7)
    words = [f"v{rng.randrange(400)}" for _ in range(20_000)]
    words[500:550] = LONG.split()
    m, a = frames(spark, [" ".join(words)], [("long", LONG), ("short", "v1"), ("pair", "v2 v3")])
    runs = entities.alias_runs(m, entities.alias_index(a), "id", "t")
    made = runs.groupBy("n").count().collect()
    assert {r.n: r["count"] for r in made}.get(50) <= 6 and sum(r["count"] for r in made) < 200
    assert {r.entity_id for r in entities.alias_match_join(m, a, "id", "t").collect()} >= {"long", "short"}


def test_repeated_and_missing_rows(spark):
    m = spark.createDataFrame([(1, "liquid"), (1, "liquid"), (1, "pp"), (2, None)], "id bigint, t string")
    a = spark.createDataFrame([("liq", "liquid"), ("liq", "LIQUID"), ("none", None), ("none", "!"), ("pp", "pp")], "entity_id string, alias string")
    assert {tuple(r) for r in entities.alias_match_join(m, a, "id", "t").collect()} == {(1, "liq"), (1, "pp")}
    assert entities.alias_match_join(m.limit(0), a, "id", "t").count() == 0 and entities.alias_match_join(m, a.limit(0), "id", "t").count() == 0
