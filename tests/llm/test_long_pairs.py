"""Preference pairs of many turns: parts that say what the whole says."""

import random

import pytest

from corpusmill.llm import preferences

KIND = "pair_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("n", [3, 256, 700])
def test_parts_join_to_the_whole(spark, n):
    rng = random.Random(n)
    rows = [(p, t, rng.choice(["user", "assistant", None]), "wö" * rng.randrange(4)) for p in range(6) for t in range(0, n, 1 + p % 2)]
    # Sides part at the start, in the middle, at the very end and never; one goes on longer.
    other = [(p, t, r, x + "!" if p < 4 and t >= [0, n // 2, n - 1, n // 3][p] else x) for p, t, r, x in rows] + [(5, n + t, "assistant", "more") for t in range(300)]
    chosen, rejected = spark.createDataFrame(rows, KIND), spark.createDataFrame(other, KIND)
    parts = preferences.preference_pairs(chosen, rejected)
    whole = {r.pair_id: r for r in preferences.preference_pairs(chosen, rejected, 10**9).collect()}
    got = {r.pair_id: r for r in preferences.whole_pairs(parts).collect()}
    assert got.keys() == whole.keys()
    for p, r in got.items():
        w = whole[p]
        assert all(r[c] == w[c] for c in ("n_common", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"))
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for a, b in (map(int, x.split(":")) for x in mask.split(",") if x):
                assert text[:a].endswith("assistant\n") and text[a:b].endswith("<|im_end|>") and "<|im_start|>" not in text[a:b]
    assert {(r.pair_id, r.n_common) for r in parts.collect()} == {(p, w.n_common) for p, w in whole.items()}
