"""Names of four languages, reliabilities against plain expectation-maximisation, and the classifier's optimum."""

import math
import random

import numpy as np
import pytest

from corpusmill.llm import pii

MODEL = pii.SpanClassifier.train({})


def found(text, model=MODEL):
    return [(k, text[a:b]) for k, a, b, own in model.spans(text) if not own]


@pytest.mark.parametrize("text,name", [
    ("Mary Smith, 12 High Street", "Mary Smith"), ("Herr Klaus Mueller kommt", "Klaus Mueller"), ("My name is José García.", "José García"),
    ("Dr. Anna Müller", "Anna Müller"), ("Frau Ursula von der Leyen sagt", "Ursula von der Leyen"), ("Je m'appelle Élodie Dupont", "Élodie Dupont"),
    ("me llamo Lucía Núñez y", "Lucía Núñez"), ("Yesterday Jean-Paul O'Brien came", "Jean-Paul O'Brien"), ("Mr. Jones", "Jones"),
    ("Señora Ñáñez Ruiz", "Ñáñez Ruiz"), ("Sincerely, Karen Ødegård", "Karen Ødegård"),
])
def test_names_are_found_whole(text, name):
    assert found(text) == [("name", name)]


@pytest.mark.parametrize("text", ["Mr. President", "Best regards, Team Support", "Herr Präsident", "Monsieur le Maire", "Madame Présidente", "Prof. ", "the Mary rose",
                                  "Der Hund und die Katze", "MARY SMITH", "Marys Smith", "my name is mud", "Mit freundlichen Grüßen, Ihr Team"])
def test_what_is_no_name(text):
    assert found(text) == []


def test_spelled_addresses_of_short_hosts():
    assert found("joe (at) x (dot) com") == [("email", "joe (at) x (dot) com")]


def test_base_spans_are_what_they_were():
    text = "Mary Smith bob@x.org and Dr. Anna Müller 10.0.0.3"
    assert [(k, text[a:b]) for k, a, b, own in MODEL.spans(text) if own] == [("email", "bob@x.org"), ("ip", "10.0.0.3")]


def test_a_labeler_that_errs_for_one_kind_stays_reliable_for_others():
    name, card = pii.KINDS.index("name"), pii.KINDS.index("card")
    kinds = np.array([name] * 4 + [card] * 4)
    # For names the third labeler is right when the first two agree; for cards it always votes yes.
    voted = np.array([[1, 1, 1, 1, 0], [0, -1, -1, 0, -1], [1, 1, 1, 0, 0], [0, -1, -1, 0, 0]] + [[1, 1, 1, 1, 0], [0, -1, 1, 0, -1], [1, 1, 1, 0, 0], [0, -1, 1, 0, -1]])
    table, _, _ = pii.reliabilities(kinds, voted, np.full(8, 200.0))
    assert table[1, name, 2, 0] > 0.9 and table[1, card, 2, 0] < 0.1


def plain_em(items, rounds=50):
    """One item at a time: (kind, votes)."""
    prior = [[1, 4, 5], [5, 4, 1]]
    kinds = range(len(pii.KINDS))
    table = [[[[x / 10 for x in prior[c]] for _ in range(5)] for _ in kinds] for c in (0, 1)]
    share = [0.5] * len(pii.KINDS)
    for _ in range(rounds):
        p = []
        for k, votes in items:
            yes, no = share[k], 1 - share[k]
            for i, v in enumerate(votes):
                yes *= table[0][k][i][v + 1]
                no *= table[1][k][i][v + 1]
            p.append(yes / (yes + no))
        seen = [[[list(map(float, prior[c])) for _ in range(5)] for _ in kinds] for c in (0, 1)]
        for (k, votes), x in zip(items, p):
            for i, v in enumerate(votes):
                seen[0][k][i][v + 1] += x
                seen[1][k][i][v + 1] += 1 - x
        table = [[[[x / sum(row) for x in row] for row in per] for per in side] for side in seen]
        share = [(sum(x for (j, _), x in zip(items, p) if j == k) + 2) / (sum(j == k for j, _ in items) + 4) for k in kinds]
    return table, share, p


@pytest.mark.parametrize("seed", range(3))
def test_reliabilities_against_plain_em(seed):
    rng = random.Random(seed)
    patterns = sorted({(rng.randrange(len(pii.KINDS)), *(rng.choice([-1, 0, 1]) for _ in range(5))) for _ in range(25)})
    counts = [rng.randrange(1, 9) for _ in patterns]
    table, share, probability = pii.reliabilities(np.array([p[0] for p in patterns]), np.array([p[1:] for p in patterns]), np.array(counts, float))
    items = [(p[0], p[1:]) for p, n in zip(patterns, counts) for _ in range(n)]
    want_table, want_share, want = plain_em(items)
    assert np.allclose(table, want_table) and np.allclose(share, want_share)
    ends = np.cumsum(counts) - 1
    assert np.allclose(probability, np.array(want)[ends])


def test_the_classifier_is_near_its_optimum():
    rng = random.Random(4)
    counts = {f"{rng.randrange(len(pii.KINDS))}|{','.join(str(rng.choice([-1, 0, 1])) for _ in range(5))}|{','.join(str(rng.randrange(2)) for _ in range(4))}":
              rng.randrange(1, 50) for _ in range(60)}

    def told(steps):
        model = pii.SpanClassifier.train(counts, steps)
        return np.array([model.probability(k) for k in sorted(counts)])

    near, far = told(400), told(20_000)
    assert np.abs(near - far).max() < 0.1 and ((near >= pii.ADD_FROM) == (far >= pii.ADD_FROM)).mean() > 0.95


def test_probabilities_are_numbers():
    assert all(0 < MODEL.probability(f"{k}|1,1,1,1,0|0,0,0,0") < 1 and not math.isnan(MODEL.probability(f"{k}|-1,-1,-1,0,-1|1,1,1,1")) for k in range(len(pii.KINDS)))
