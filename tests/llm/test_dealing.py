"""Even dealing, bounded samples, short texts, very many special tokens."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, language, quality, winnowing


def test_special_tokens_take_one_pass():
    from tokenizers import Tokenizer
    whole, coder = Tokenizer.from_file(bpe.default_path()), bpe.ForcedBoundaryBpe(bpe.default_path())
    some = "<|endoftext|>a<|startoftext|><|endoftext|> b " * 20 + "<|endoftext"
    assert coder.encode(some) == whole.encode(some, add_special_tokens=False).ids
    start = time.time()
    assert len(coder.encode("<|endoftext|>x " * 100_000)) == 200_000
    assert time.time() - start < 20


def test_every_part_is_a_task_of_its_own(spark):
    df = spark.range(0, 6400, 1, 4).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    rows = winnowing.next_texts(df, 64).select("part", F.spark_partition_id().alias("task")).groupBy("task", "part").count().collect()
    assert len({r.task for r in rows}) == len({r.part for r in rows}) == len(rows) >= 60 and max(r["count"] for r in rows) < 400


def test_an_id_of_most_rows_fills_many_parts(spark):
    ids = [None] * 1000 + [7] * 1000 + list(range(1000))
    df = spark.createDataFrame([(d, f"text number {i} of some length") for i, d in enumerate(ids)], "doc_id bigint, text string").repartition(5)
    parts = Counter(r.part for r in winnowing.next_texts(df, 16).collect())
    assert len(parts) >= 12 and max(parts.values()) < 600
    got = winnowing.compare_with_next(df, parts=16).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)
    # Each row's second half comes from the next one, so every text but for its number is found twice.
    assert all(r.edited.startswith("text number") for r in got)


def by_hand(rows, k, window):
    """(doc_id, near_edited, near_next) with plain windows over Python lists; ids differ."""
    def marks(text):
        if not text:
            return set()
        kk, w = winnowing.sizes(len(text), k, window)
        h = [int(x) for x in winnowing.gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), kk)]
        return {h[max(range(i, i + w), key=lambda p: (-h[p], p))] for i in range(len(h) - w + 1)}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    rows, out = sorted(rows), []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out.append((i, round(like(marks(text), marks(edited)), 12), round(like(marks(text), marks(after)), 12)))
    return out


def test_likeness_against_plain_windows(spark):
    rng = np.random.default_rng(9)
    words = ["alpha", "beta ", "γάμμα", " ", "delta,", "e", "😀"]
    rows = [(i, "".join(rng.choice(words, rng.integers(0, 120)))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + "tail") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = [(r.doc_id, round(r.near_edited, 12), round(r.near_next, 12)) for r in winnowing.compare_with_next(df, parts=7).collect()]
    assert sorted(got) == by_hand(rows, winnowing.K, winnowing.WINDOW)


def test_short_texts_keep_a_likeness_when_half_stays():
    rng = np.random.default_rng(10)
    alike = {}
    for n in (30, 60, 100, 160, 400):
        for _ in range(200):
            a, b = ("".join(rng.choice(list("abcdefghij klmnop"), n)) for _ in range(2))
            mixed = a[:n - n // 2] + b[:n // 2]
            alike.setdefault(n, []).append(winnowing.likeness(winnowing.winnow(a)[0], winnowing.winnow(mixed)[0]))
    assert all(np.mean(np.array(x) > 0) > (0.9 if n < 100 else 0.99) for n, x in alike.items()), {n: np.mean(np.array(x) > 0) for n, x in alike.items()}


def test_a_shared_run_is_seen_whatever_the_windows():
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    for n, m in ((80, 80), (80, 2000), (150, 700), (507, 508), (3000, 90)):
        for _ in range(40):
            run = "".join(rng.choice(letters, 80))
            a, b = ("".join(rng.choice(letters, x - 80)) for x in (n, m))
            i, j = rng.integers(0, len(a) + 1), rng.integers(0, len(b) + 1)
            left, right = (winnowing.winnow(t[:p] + run + t[p:])[0] for t, p in ((a, i), (b, j)))
            assert set(left.tolist()) & set(right.tolist())


def test_language_sample_is_cut_before_it_is_ordered(spark):
    df = spark.range(0, 60_000, 1, 6).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text of all' ELSE concat('words ', id, ' more') END AS text",
                                              "CASE WHEN id % 10 = 1 THEN 'xx' ELSE 'en' END AS lang")
    learned = language.fit(df, sample_docs=50)
    assert list(learned) == ["en", "xx"]
    assert learned["en"].count(b"words") == 50 or learned["en"].count(b"words") == 49  # the repeated row is one sample at most
    assert language.fit(df.repartition(11), sample_docs=50) == learned
    assert list(language.fit(df, languages=1)) == ["en"]
    few = spark.createDataFrame([(1, "nur ein Satz", "de")] * 500 + [(2, "one sentence only", "en")], "doc_id bigint, text string, lang string")
    assert list(language.fit(few)) == ["de", "en"]


def test_quality_rows_are_bounded_after_the_join(spark):
    docs = spark.range(3000).selectExpr("1 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    seen = []
    fit = quality.Forest.fit
    try:
        quality.Forest.fit = classmethod(lambda cls, x, y: seen.append(len(y)) or fit(x, y))
        quality.fit(docs, labels, rows=100)
    finally:
        quality.Forest.fit = fit
    assert seen == [100]


@pytest.mark.parametrize("seed", range(3))
def test_the_first_split_is_the_best_one(seed):
    """A forest of one step against every possible cut, by the same gain."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, seed] > 6) ^ (rng.random(300) < 0.1)).astype(float)
    forest = quality.Forest.fit(x, y)
    f, t = int(forest.feature[0, 0]), float(forest.threshold[0, 0])
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(mask):
        return sum(g[m].sum() ** 2 / (h[m].sum() + quality.L2) for m in (mask, ~mask))

    best = max(gain(x[:, i] > c) for i in range(3) for c in range(12))
    assert f == seed and gain(x[:, f] > t) == pytest.approx(best)
