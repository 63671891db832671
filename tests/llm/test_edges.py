"""Odd input for every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, exact_topk, html_text, language, mixing, ngram_join, pii, preferences, quality, winnowing

LONG = " ".join(f"word{i}, and" for i in range(30_000))
DOCS = [(1, None, "en", "a"), (2, "", "en", None), (3, "one two three four five six seven", None, "a"), (3, "one two three four five six seven", None, "a"),
        (4, LONG, "en", "b"), (5, "  \n\t ", "fr", "b"), (6, "One TWO three four five six seven", "en", None), (7, "12 345 !!", "en", "a"),
        (None, "der Hund und die Katze", "de", "a"), (8, "été à la forêt", "fr", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string")
    # Names that the operators use for their results.
    for name in ("score", "size", "taken", "ids", "spans", "component_id", "hashes", "lang_pred", "_made"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(DOCS) and all(r.taken == r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) <= own[0].target + 0.5 and sum(r["size"] for r in own) == own[0].source_size
    assert {r["size"] for r in rows if not (r.text or "").strip()} == {0}
    again = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and mixing.mix(nothing).count() == 0


def test_mixing_plan_against_all_subsets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes, counts = rng.integers(1, 30, 4), rng.integers(1, 4, 4)
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        whole = mixing.knapsack(sizes, counts, budget)
        assert (whole <= counts).all() and (sizes * whole).sum() == max(x for x in sums if x <= budget)
        near = mixing.fit(sizes, counts, budget)
        assert (near <= counts).all() and budget - sizes.max() < (sizes * near).sum() <= budget


def test_targets_stop_at_three_sizes():
    got = mixing.targets({"b": 10, "a": 100, None: 5, "c": 1000}, 1115)
    assert got["b"] == 30 and got[None] == 15 and got["a"] == 300 and math.isclose(sum(got.values()), 345 + got["c"])
    assert list(mixing.targets({}, 0)) == []


def test_winnowing(spark, docs, nothing):
    rows = winnowing.fingerprints(docs).collect()
    assert len(rows) == len(DOCS) and rows[0].hashes == [] and rows[2].hashes == rows[3].hashes != []
    near = winnowing.compare_with_next(docs, parts=3).collect()
    assert len(near) == len(DOCS) and winnowing.compare_with_next(nothing).count() == 0
    order = sorted(((d[0] if d[0] is not None else -2**63, d[1] or "", d[0]) for d in DOCS), key=lambda x: x[:2])  # only equal texts share an id
    want = sorted((d[2] or -1, o[1][:len(o[1]) - len(o[1]) // 2] + n[1][:len(o[1]) // 2]) for o, n, d in zip(order, order[1:] + order[:1], order))
    assert sorted((r.doc_id or -1, r.edited) for r in near) == want
    one = winnowing.compare_with_next(spark.createDataFrame([(9, "abcd")], "doc_id bigint, text string")).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abab", 1.0)]


def test_winnowing_against_plain_windows():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 19, 20, 60, 81, 300):
        text = "".join(rng.choice(list("abé😀"), n))
        k, w = winnowing.sizes(n)
        hashes, places = winnowing.winnow(text)
        if not n:
            assert len(hashes) == 0
            continue
        plain = winnowing.gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
        assert all(int(plain[i]) == int(plain[j]) for i in range(len(plain)) for j in range(len(plain)) if text[i:i + k] == text[j:j + k])
        width = min(w, len(plain))
        want = sorted({max(range(i, i + width), key=lambda p: (-int(plain[p]), p)) for i in range(len(plain) - width + 1)})
        assert places.tolist() == want and hashes.tolist() == [int(plain[p]) for p in want]


def test_bpe_against_the_library(docs, nothing):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(bpe.default_path())
    rows = bpe.encode_decode(docs, bpe.default_path()).collect()
    assert len(rows) == len(DOCS) and rows[0].ids == [] and rows[0].decoded == ""
    for r in rows:
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == whole.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(nothing, bpe.default_path()).count() == 0
    odd = ["<|endoftext|>a<|startoftext|> <|endoftext|", "I'M don't 'S", "é́ ẞ İ ﬁ ３4", "x\u0085y\x1cz　q​w e", "a\r\nb\tc", "\x00", "…—“”", "ab,cd.e;", "﻿", "z" * 5000]
    coder = bpe.ForcedBoundaryBpe(bpe.default_path())
    assert coder.encode_batch(odd) == [e.ids for e in whole.encode_batch(odd, add_special_tokens=False)]


def test_language(docs, nothing):
    learned = language.fit(docs)
    assert list(learned) == ["de", "en", "fr"] and language.fit(nothing) == {}
    rows = language.identify(docs, learned).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 5, 7)] == ["und"] * 4
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"} and language.identify(nothing, learned).count() == 0


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (99, 1), (7, None), (None, 1)], "doc_id bigint, quality int")
    forest = quality.fit(docs, labels)
    rows = quality.score(docs, forest).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score
    assert quality.score(nothing, forest).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_forest_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = quality.Forest.fit(x[:2000], y[:2000])
    assert ((forest.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = forest.predict(x[2000:2001])  # one row alone, walked tree by tree
    z = forest.base
    for f, t, v in zip(forest.feature, forest.threshold, forest.value):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(x[2000, f[node]] > t[node])
        z += v[node - len(f)]
    assert math.isclose(one[0], 1 / (1 + math.exp(-z)))


def test_ngram_join(spark, docs, nothing):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (5, 0, 5), (3, 3, 3), (6, 3, 3), (7, 1, 7), (8, 1, 8), (None, 1, None)} <= rows
    assert ngram_join.jaccard_join(docs).count() == len(DOCS) and ngram_join.jaccard_join(nothing).count() == 0


def test_pii(docs, nothing):
    model = pii.fit(docs)
    assert pii.find(nothing, model).count() == 0 and pii.find(docs, pii.fit(nothing)).count() == len(DOCS)
    assert all(r.spans == [] for r in pii.find(docs, model).collect())


def test_preferences(spark):
    kind = "pair_id bigint, turn bigint, role string, text string, prompt string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (1, 1, "assistant", "yes", ""), (2, 0, None, None, ""),
                                    (3, 0, "user", "a", ""), (None, 0, "user", "b", ""), (4, 0, "user", "x", ""), (4, 600, "assistant", "y", "")], kind)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "nö", ""), (2, 0, None, None, ""), (4, 0, "user", "x", ""),
                                      (5, 2, "assistant", "only", "")], kind)
    rows = {(r.pair_id, r.segment): r for r in preferences.preference_pairs(chosen, rejected).collect()}
    assert rows[1, 0].prompt == "<|im_start|>user\nhi<|im_end|>\n" and rows[1, 0].n_common == 1
    assert rows[1, 0].chosen == "<|im_start|>assistant\nyes<|im_end|>\n" and rows[1, 0].chosen_mask == "22:35"
    assert rows[1, 0].rejected[22:34] == "nö<|im_end|>" and rows[1, 0].rejected_mask == "22:34"
    assert rows[2, 0].prompt == "<|im_start|>unknown\n<|im_end|>\n" and rows[2, 0].chosen == rows[2, 0].rejected == ""
    assert rows[3, 0].prompt == "" and rows[3, 0].rejected == "" and rows[5, 0].chosen == "" and (4, 2) in rows and len(rows) == 6
    assert preferences.preference_pairs(chosen.limit(0), rejected.limit(0)).count() == 0


def test_exact_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (None, [1.0, 1.0]), (6, [0.3]), (7, [-1.0, 0.016]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in exact_topk.exact_topk(df.where("vec_id % 20 = 0"), df, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5120), (0, 2, 20, 5120), (0, 3, 7, -4064), (20, 1, 0, 5120), (20, 2, 1, 5120), (20, 3, 7, -4064)]
    assert exact_topk.exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_against_sorting():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40):
        scores, ids = rng.integers(-3, 3, (6, n)), np.sort(rng.choice(100, n, replace=False))
        s, i = exact_topk.best(scores, ids[None, :], 7)
        for row, a, b in zip(scores, s, i):
            want = sorted(zip(-row, ids))[:7]
            assert [(-int(x), y) for x, y in zip(a, b)][:len(want)] == [(x, y) for x, y in want]
    big = np.array([[2**40, -2**40]])
    assert exact_topk.products(big, big)[0, 0] == np.iinfo(np.int64).max


PAGES = {
    "plain": ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T&amp;t</h1><p>One,  two.<br>Three <b>four</b></p><p>Five</article><footer>f</footer>", "T&t\nOne, two. Three four\nFive"),
    "divs": ("<div id=sidebar><p>" + "Aside, text. " * 30 + "</p></div><div class='post-content'><h2>H</h2><p>" + "Real words, here. " * 20 + "</p><div class=comments><p>nice, nice, nice " + "x " * 90
             + "</p></div></div><div class=cookie-notice>We use cookies</div>", "H\n" + ("Real words, here. " * 20).strip()),
    "cut": ("<article><p>a &am</p><p>b<scr", "a &am\nb"), "comment": ("<main><p>a<!-- <p>no</p> -->b</p></main>", "ab"), "none": ("", ""), "text": ("just text", "just text"),
    "script": ("<main><script>var a='<p>x</p>'</script><p>y</p><style>p{}</style><form><p>no</p></form></main>", "y"), "sign": ("<main><p>1 < 2 > 0</p></main>", "1 < 2 > 0"),
    "list": ("<article><p>Read, this, and that.</p><ul><li><a href=a>Link one</a><li><a href=b>Link two</a></ul><ul><li>Point</ul></article>", "Read, this, and that.\nLink one\nLink two\nPoint"),
    "unclosed": ("<article><p>x <a href=\"y>z</p></article>", None), "deep": ("<div>" * 3000 + "<p>deep</p>", "deep"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    source, want = PAGES[name]
    got = html_text.main_text(source)
    assert want is None or got == want


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "<p>a</p>", "y")], "page_id bigint, html string, text string")
    assert sorted((r.page_id, r.text) for r in html_text.extract(df).collect()) == [(1, ""), (1, ""), (2, "a")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_spans_and_masks():
    text = "Mail bob@x.org or +1 (826) 555-4081 190 123. Card 4111 1111 1111 1111, host 10.0.0.300 10.0.0.3."
    base = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in base] == [("email", "bob@x.org"), ("ip", "10.0.0.3"), ("card", "4111 1111 1111 1111")]
    model = pii.SpanClassifier.train({pii.pattern(text, (*s, True)): 50 for s in base})
    found = [(k, text[a:b], own) for k, a, b, own in model.spans(text)]
    assert ("phone", "(826) 555-4081", False) in found and sum(own for *_, own in found) == 3
    assert pii.masked("ab@c.de, x", [("email", 0, 7, True), ("name", 3, 5, False)]) == "[EMAIL], x"
