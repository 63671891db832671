"""The registered queries over whole small tables, against SQL or brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pandas as pd
import pytest

import __spark_entry__ as entry
from corpusmill.llm import pii
from corpusmill.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet")


def got(spark, name):
    return QUERIES[name](spark, FOLDER).toPandas()


def test_all_are_registered():
    assert {re.match(r"op(\d+)_", k)[1] for k in QUERIES} == {str(i) for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    diff, n = compare(connect(FOLDER), ORACLES[name], QUERIES[name](spark, FOLDER))
    assert not diff and n, diff


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)]) if words else frozenset()


def groups(texts):
    """Component of every id by comparing all pairs that share an n-gram."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent, holders = {i: i for i in sets}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, s in sorted(sets.items()):
        near = defaultdict(int)
        for g in s:
            for j in holders[g]:
                near[j] += 1
            holders[g].append(i)
        for j, n in near.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join(spark, docs):
    want = groups(dict(zip(docs.doc_id, docs.text)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got(spark, "op1_ngram_join").itertuples()} == want


def test_ngram_join_of_a_large_group(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {400 + i: " ".join(base[:60] + [f"o{i}_{k}" for k in range(40)]) for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    from corpusmill.llm.ngram_join import jaccard_join
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df).collect()} == groups(texts)


def test_pages(spark):
    rows = got(spark, "op2_html_text")
    assert len(rows) == 50 and (rows.n_chars == rows.text.str.len()).all() and (rows.n_chars > 0).all()
    assert not rows.text.str.contains("©|<p>|track\\(", regex=True).any()


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    from corpusmill.llm.bpe import default_path
    whole = Tokenizer.from_file(default_path())
    texts = dict(zip(docs.doc_id, docs.text))
    for r in got(spark, "op3_forced_bpe").itertuples():
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language_and_quality_on_what_was_held_out(spark, docs):
    told = got(spark, "op5_language").merge(docs, on="doc_id")
    assert (told.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in told.doc_id]).all()
    assert (told.lang_pred == told.lang)[told.held_out].mean() > 0.93
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    scored = got(spark, "op7_quality")
    assert len(scored) == len(docs) and (scored.predicted == (scored.score >= 0.3)).all()
    held = scored.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() > 0.85


def test_mixing(spark, docs):
    rows = got(spark, "op8_mixing")
    assert len(rows) == len(docs) and (rows.taken <= 3 * rows["size"]).all()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.target - by.taken).abs() <= by.most).all() and abs(by.target.sum() - rows["size"].sum()) < 1


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                    "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(RULES).index(s[0])))


def test_pii(spark, docs):
    texts = dict(zip(docs.doc_id, docs.text))
    for r in got(spark, "op9_pii").itertuples():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert r.n_email == sum(k == "email" for k, *_ in want) and {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


def test_base_rules_on_random_texts():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x.y", ".", "1", "23", "4111 1111 1111 1111", "255", "0.", "-", " ", "+1", "(555)", "+", "%", "\n", "é", "1.2.3.4"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert [s[:3] for s in pii.proposed(text) if s[3]] == base(text), text


def test_fingerprints(spark, docs):
    order = docs.sort_values("doc_id")
    texts = order.text.tolist()
    rows = got(spark, "op10_winnowing").sort_values("doc_id")
    for text, following, r in zip(texts, texts[1:] + texts[:1], rows.itertuples()):
        half = len(text) // 2
        assert r.edited_sha256 == hashlib.sha256((text[:len(text) - half] + following[:half]).encode()).hexdigest() and r.n_chars == len(text)
    same = {}
    assert all(same.setdefault(t, m) == m for t, m in zip(texts, rows.fingerprint)) and rows.near_edited.mean() > 0.2 > rows.near_next.mean()


def test_pipeline(spark, docs):
    """Stage by stage against what each must do to its own input."""
    import corpus_pipeline as P
    from corpusmill.llm.language import Compressors, fit
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["language_id", "near_duplicates", "personal_data", "mixture", "tokens"]
    model, kept = Compressors(fit(frame)), P.language_id(spark, frame, FOLDER).toPandas()
    assert set(kept.doc_id) == {i for i, t in zip(docs.doc_id, docs.text) if not model.predict(t)[2]} and list(kept) == list(docs)
    frame = spark.createDataFrame(kept, frame.schema)
    single = P.near_duplicates(spark, frame, FOLDER).toPandas()
    want = groups(dict(zip(kept.doc_id, kept.text)))
    assert sorted(single.doc_id) == sorted(i for i, (_, c) in want.items() if c == i)
    clean = P.personal_data(spark, spark.createDataFrame(single, frame.schema), FOLDER).toPandas()
    assert len(clean) == len(single) and not any(base(t) for t in clean.text) and (clean.n_chars == clean.text.str.len()).all()
    frame = spark.createDataFrame(clean, frame.schema)
    mixed = P.mixture(spark, frame, FOLDER).toPandas()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in zip(clean.doc_id, clean.text)}
    assert mixed.doc_id.value_counts().max() <= 3 and abs(sum(words[i] for i in mixed.doc_id) / sum(words.values()) - 1) < 0.02
    tokens = P.tokens(spark, spark.createDataFrame(mixed, frame.schema), FOLDER).toPandas()
    assert len(tokens) == len(mixed) and (tokens.n_tokens == tokens.ids.str.len()).all()
    assert P.run(spark, FOLDER).count() == len(tokens)


