"""Quality scores by histogram gradient-boosted trees over statistics of whole texts.

Trees are complete and of one depth, so a forest is three arrays and all trees of all rows of a batch are walked at once.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import append

#: Bound of the labelled sample a forest is fitted on; beyond it, rows are drawn by a hash of doc_id.
TRAIN_ROWS = 50_000
TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 100, 4, 64, 0.1, 1.0, 8
STATISTICS = ["log_chars", "log_words", "word_chars", "upper", "digits", "marks", "blanks", "lines", "shouts", "symbol_runs", "distinct_words",
              "top_word", "repeated_grams", "repeated_lines", "line_chars", "stops", "packed", "long_words", "capital_words"]


def classes() -> np.ndarray:
    """For each code point of the basic plane: 1 lower-case or other letter, 2 upper-case letter, 3 digit, 4 white space, 0 other."""
    chars = [chr(i) for i in range(0x10000)]
    return np.array([2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 0 for c in chars], dtype=np.uint8)


def statistics(text: str | None, kinds: np.ndarray) -> np.ndarray:
    """Figures of one whole text; null counts as empty, and an empty text has zeros."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kinds[np.minimum(codes, 0xFFFF)]
    n, by = len(codes), np.bincount(kind, minlength=5)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    w = max(1, len(words))
    counts = Counter(words)
    ids = dict(zip(counts, range(len(counts))))
    number = np.array([ids[x] for x in words], dtype=np.uint64)
    repeated = 0.0
    if len(words) >= 5:
        grams = np.zeros(len(words) - 4, dtype=np.uint64)
        for i in range(5):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + number[i:i + len(grams)] + np.uint64(1)
        repeated = 1 - len(np.unique(grams)) / len(grams)
    other = kind == 0
    runs = int(np.count_nonzero(other[1:] & other[:-1] & (codes[1:] == codes[:-1])))
    out[:] = (np.log1p(n), np.log1p(len(words)), (n - by[4]) / w, by[2] / n, by[3] / n, by[0] / n, by[4] / n, text.count("\n") / n,
              text.count("!") / w, runs / w, len(counts) / w, max(counts.values(), default=0) / w, repeated,
              1 - len(set(lines)) / max(1, len(lines)), len(lines) and n / len(lines), (text.count(".") + text.count("?")) / w,
              len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) / n, sum([len(x) > 20 for x in counts]) / w,
              sum([c for x, c in counts.items() if x[:1].isupper()]) / w)
    return out


class Forest:
    """Boosted trees for a yes-or-no label under log loss."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
        """``x``: rows by statistics; ``y``: 0 or 1. Without rows of both labels, every score is the share of ones (0.5 of none)."""
        share = float(y.mean()) if len(y) else 0.5
        inner, leaves = 2**depth - 1, 2**depth
        if share in (0.0, 1.0) or not len(y):
            share = min(max(share, 0.01), 0.99)
            return cls(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        base = float(np.log(share / (1 - share)))
        scores = np.full(len(y), base)
        feature, threshold, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        for t in range(trees):
            p = 1 / (1 + np.exp(-scores))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(depth):
                width = 2**level
                gain, at = np.zeros(width), np.zeros((width, 2), np.int64)
                for f in range(x.shape[1]):
                    key = node * BINS + bins[:, f]
                    sums = [np.bincount(key, weights=v, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h, None)]
                    left, whole = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                    right = [a - b for a, b in zip(whole, left)]
                    better = left[0]**2 / (left[1] + L2) + right[0]**2 / (right[1] + L2) - whole[0]**2 / (whole[1] + L2)
                    better[(left[2] < LEAST_ROWS) | (right[2] < LEAST_ROWS)] = 0
                    better[:, len(edges[f]):] = 0
                    best = better.argmax(axis=1)
                    more = better[np.arange(width), best] > gain + 1e-9
                    gain[more] = better[np.arange(width), best][more]
                    at[more] = np.stack([np.full(width, f), best], axis=1)[more]
                for i in np.flatnonzero(gain > 0):
                    feature[t, width - 1 + i], threshold[t, width - 1 + i] = at[i, 0], edges[at[i, 0]][at[i, 1]]
                f = feature[t, width - 1 + node]
                node = node * 2 + (x[np.arange(len(y)), f] > threshold[t, width - 1 + node])
            value[t] = -RATE * np.bincount(node, weights=g, minlength=leaves) / (np.bincount(node, weights=h, minlength=leaves) + L2)
            scores += value[t][node]
        return cls(base, feature, threshold, value)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all trees step down one level at a time."""
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), dtype=np.int64)
        tree = np.arange(trees)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node - inner].sum(axis=1))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Forest from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality). At most ``rows`` labelled rows are used.

    Labels other than 0 and 1, and labels without a document, don't count; a repeated label counts each time, and so does a
    document that repeats a labelled id, up to ``rows`` rows in all, drawn by a hash of the id.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    drawn = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows))  # at most ``rows`` pairs of numbers
    kinds = classes()

    @F.pandas_udf("array<double>")
    def figures(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t, kinds) for t in texts])

    told = docs.select("doc_id", "text").join(drawn, "doc_id").select(figures("text").alias("x"), "quality", "doc_id")
    found = told.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(rows).toPandas()
    found = found.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(STATISTICS))
    return Forest.fit(x, found["quality"].to_numpy(float))


def score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` with score double, the probability of label 1. Rows stay where they are; null and empty texts are scored
    by their zeros; a column named score is replaced."""
    kinds = classes()

    @F.pandas_udf("score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        x = np.array([statistics(t, kinds) for t in texts]).reshape(len(texts), len(STATISTICS))
        return pd.DataFrame({"score": forest.predict(x)})

    return append(docs, scored(F.col(text)), ["score"])
