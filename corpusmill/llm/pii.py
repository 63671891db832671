"""Personal data by weak supervision.

Patterns propose spans; regex, checksum, gazetteer and context labelers vote on each. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is for each kind and how likely each pattern is personal data;
those probabilities train a final span classifier that also sees the shape of a span. Spans of the four base rules always stay,
others are added when the classifier says so. What travels to the driver are counts of patterns: their number is bounded
by kinds, votes and shapes, not by documents.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import append

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "name", "number", "account"]
LABELERS = ["form", "checksum", "gazetteer", "cue", "other_use"]
CONTEXT = 32
ADD_FROM = 0.5

# The base rules.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Weaker forms, gazetteers and cues.
SPELLED = re.compile(r"(?<![\w.+-])[A-Za-z0-9._+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,24})+")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
NUMBER = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")
# A capitalised word of any script, also O'Brien and Jean-Paul, and up to four of them with particles between.
CAPITAL = r"\p{Lu}(?:['’]\p{Lu})?[\p{Ll}\p{M}]{1,20}(?:-\p{Lu}[\p{Ll}\p{M}]{1,20})?"
PARTICLES = r"(?:(?:von|van|der|den|de|du|di|da|del|dos|la|le|zu)\x20){0,2}"
NAMED = regex.compile(rf"[\x20\t]*+({CAPITAL}(?:\x20{PARTICLES}{CAPITAL}){{0,3}})(?![\w])")
CAPITALS = regex.compile(rf"(?<![\w'’-]){CAPITAL}(?:\x20{PARTICLES}{CAPITAL}){{1,3}}(?![\w])")
NAME_CUES = ["my name is", "My name is", "Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ", "Sincerely, ", "Best regards, ",
             "mein Name ist", "Mein Name ist", "Ich heiße", "ich heiße", "Herr ", "Herrn ", "Frau ", "Mit freundlichen Grüßen, ",
             "je m'appelle", "Je m'appelle", "mon nom est", "Mon nom est", "Monsieur ", "Madame ", "Mme ", "Cordialement, ",
             "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "Señor ", "Señora ", "Sr. ", "Sra. ", "Atentamente, "]
GIVEN = frozenset("""James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara
 Susan Jessica Sarah Karen Christopher Daniel Matthew Anthony Mark Donald Steven Andrew Paul Joshua Kenneth Kevin Brian George Edward Emily
 Nancy Lisa Betty Margaret Sandra Ashley Emma Olivia Anna Maria Peter Hans Klaus Jürgen Wolfgang Günter Werner Helmut Heinz Karl Franz Stefan
 Andreas Ursula Monika Petra Sabine Renate Helga Ingrid Brigitte Gisela Greta Jean Pierre Michel André Philippe Jacques François Louis Henri
 Marie Claire Isabelle Sylvie Catherine Nathalie Monique Françoise Chantal Camille Luis Carlos Jose José Juan Antonio Manuel Francisco
 Javier Miguel Pedro Diego Carmen Sofia Laura Julia Isabel Pilar Dolores Lucía Elena Rosa""".split())
# What a title or a greeting may be followed by that is nobody's name.
ROLES = frozenset("""President Prime Minister Chairman Chairwoman Chairperson Chair Speaker Secretary Director Manager Team Support Customer Service
 Sales Office Staff Committee Council Board Department Editor Ambassador Mayor Senator Governor Judge Chancellor Vice The Your Our All
 Präsident Präsidentin Minister Ministerin Bundeskanzler Kanzler Direktor Doktor Professor Bürgermeister Ihr Ihre Ihnen
 Président Présidente Ministre Directeur Directrice Maire Le La Les Votre Presidente Presidenta Ministro Ministra Alcalde El Su Usted""".split())
ENDINGS = frozenset("com org net edu gov io info biz de fr es uk us ca au eu ch at it nl example".split())
CUES = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address", "client", "login"),
    "card": ("card", "visa", "master", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "cell"),
    "number": ("ssn", "social security", "tax id"),
    "account": ("iban", "account", "bank"),
}
ENDING_CUES = tuple(c.strip() for c in NAME_CUES)
OTHER_USES = ("version", "release", "isbn", "issn", "doi", "order no", "invoice", "serial", "section", "page ", "build")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: a long run without one costs nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end and (domain := DOMAIN.match(text, at + 1)):
            width, start = 64, at
            while start > end:
                low = max(end, at - width)
                start = low + len(text[low:at].rstrip(LOCAL))
                if start > low or low == end:
                    break
                width *= 2
            if start < at:
                out.append((start, domain.end()))
                end = domain.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base rules in order of the rules."""
    out = [("email", a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return out


def names(text: str) -> list[tuple[int, int]]:
    """What stands behind a cue and is capitalised, and what begins with a listed given name and goes on capitalised; what begins with
    a role is neither."""
    found = []
    for cue in NAME_CUES:
        at = text.find(cue)
        while at >= 0:
            if (at == 0 or not text[at - 1].isalnum()) and (m := NAMED.match(text, at + len(cue))) and m[1].split()[0] not in ROLES:
                found.append(m.span(1))
            at = text.find(cue, at + len(cue))
    for m in CAPITALS.finditer(text):
        at = m.start()
        for word in m[0].split(" "):
            if word in GIVEN or word.split("-")[0] in GIVEN:
                if at + len(word) < m.end():
                    found.append((at, m.end()))
                break
            at += len(word) + 1
    return found


def proposed(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of all candidates; further ones don't overlap base spans or each other."""
    base = base_spans(text)
    more = [("email", *m.span()) for m in SPELLED.finditer(text)] if "(at)" in text or "[at]" in text else []
    if re.search("[0-9]", text):
        more += [("number", *m.span()) for m in NUMBER.finditer(text)]
        more += [("account", *m.span()) for m in ACCOUNT.finditer(text)]
        more += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
        more += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= m.end() - m.start() <= 40 and 14 <= len(only_digits(m[0])) <= 19]
    more += [("name", *span) for span in names(text)]
    out, taken = [(*s, True) for s in base], sorted((a, b) for _, a, b in base)
    free: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(more, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if not free or a >= free[-1][2]:
            free.append((kind, a, b))
    i = 0
    reach = 0
    for kind, a, b in free:
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def votes(text: str, kind: str, start: int, end: int, base: bool) -> list[int]:
    """One vote for each labeler: 1 personal, -1 not, 0 no opinion."""
    said, before = text[start:end], text[max(0, start - CONTEXT):start].lower()
    digits = only_digits(said) if kind != "name" else ""
    form = 1 if base or kind in ("number", "account") or (kind == "name" and " " in said) else 0
    if kind == "card":
        checksum = 1 if luhn(digits) else -1
    elif kind == "account":
        turned = "".join(str(int(c, 36)) for c in (said.replace(" ", "")[4:] + said[:4]))
        checksum = 1 if int(turned) % 97 == 1 else -1
    elif kind == "number":
        checksum = -1 if digits[:3] in ("000", "666") or digits[3:5] == "00" or digits[5:] == "0000" or digits[0] == "9" else 1
    elif kind == "phone":
        checksum = 1 if len(set(digits)) > 2 else -1
    else:
        checksum = 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[^a-z]+", said.lower())[-1] in ENDINGS else 0
    elif kind == "card":
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == "name":
        gazetteer = 1 if said.split()[0] in GIVEN else 0
    elif kind == "ip":
        gazetteer = -1 if said.split(".")[0] in ("0", "127", "255") else 0
    else:
        gazetteer = 0
    if kind == "name":
        cue = 1 if text[max(0, start - CONTEXT):start].rstrip(" \t").endswith(ENDING_CUES) else 0
    else:
        cue = 1 if any(c in before for c in CUES[kind]) else 0
    joined = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    other = -1 if joined or any(c in before for c in OTHER_USES) else 0
    return [form, checksum, gazetteer, cue, other]


def shape(text: str, kind: str, start: int, end: int) -> list[int]:
    """What a span looks like, apart from the votes."""
    said = text[start:end]
    return [int(end - start > 16), int(" " in said or "-" in said), int(start == 0 or text[start - 1] in "\n:"), int(end == len(text) or text[end] in "\n.,;")]


def pattern(text: str, span: tuple[str, int, int, bool]) -> str:
    kind, a, b, base = span
    return f"{KINDS.index(kind)}|{','.join(map(str, votes(text, kind, a, b, base)))}|{','.join(map(str, shape(text, kind, a, b)))}"


def parse(key: str) -> tuple[int, np.ndarray, np.ndarray]:
    kind, voted, shaped = key.split("|")
    return int(kind), np.array(voted.split(","), int), np.array(shaped.split(","), int)


def reliabilities(kinds: np.ndarray, voted: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation. Returns P(vote | class) as [class, kind, labeler, vote + 1], the share of personal data by kind and
    the probability of each pattern. A labeler is as reliable for each kind as it proves there. Pseudo-counts state that
    labelers are better than chance, so that a corpus without counter-examples doesn't teach that every vote is worthless."""
    prior = np.array([[1.0, 4.0, 5.0], [5.0, 4.0, 1.0]])[:, None, None, :] * np.ones((1, len(KINDS), voted.shape[1], 1))
    table, share = prior / prior.sum(axis=3, keepdims=True), np.full(len(KINDS), 0.5)
    probability = np.full(len(counts), 0.5)
    at = np.arange(voted.shape[1])[None, :]
    for _ in range(rounds):
        yes, no = (np.log(s[kinds]) + np.log(t[kinds[:, None], at, voted + 1]).sum(axis=1) for s, t in ((share, table[0]), (1 - share, table[1])))
        probability = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        for c, weight in ((0, probability * counts), (1, (1 - probability) * counts)):
            seen = prior[c].copy()
            np.add.at(seen, (kinds[:, None], at, voted + 1), weight[:, None])
            table[c] = seen / seen.sum(axis=2, keepdims=True)
        share = (np.bincount(kinds, probability * counts, len(KINDS)) + 2) / (np.bincount(kinds, counts, len(KINDS)) + 4)
    return table, share, probability


def inputs(kinds: np.ndarray, voted: np.ndarray, shaped: np.ndarray) -> np.ndarray:
    """Numbers the classifier sees: kind, each vote as two signs, shape."""
    return np.concatenate([np.eye(len(KINDS))[kinds], voted > 0, voted < 0, shaped], axis=1).astype(float)


class SpanClassifier:
    """Logistic regression over patterns, with the labelers' reliabilities it was trained from."""

    def __init__(self, weights: np.ndarray, table: np.ndarray, share: np.ndarray):
        self.weights, self.table, self.share = weights, table, share
        self.known: dict[str, float] = {}

    @classmethod
    def train(cls, counts: dict[str, int], steps: int = 400) -> SpanClassifier:
        """``counts``: how often each pattern was proposed. Without any, only the pseudo-counts speak."""
        # Each vote pattern of the pseudo-counts' making also trains: all for and all against, one of each kind.
        seeds = {f"{k}|1,1,1,1,0|0,0,0,0": 1 for k in range(len(KINDS))} | {f"{k}|0,-1,0,0,-1|0,0,0,0": 1 for k in range(len(KINDS))}
        whole = {key: counts.get(key, 0) + seeds.get(key, 0) for key in sorted(counts.keys() | seeds.keys())}
        kinds, voted, shaped = (np.array(x) for x in zip(*map(parse, whole)))
        n = np.array(list(whole.values()), dtype=float)
        table, share, probability = reliabilities(kinds, voted, n)
        x, weight = inputs(kinds, voted, shaped), np.log1p(n)
        w = np.zeros(x.shape[1])
        for _ in range(steps):  # Newton's method would do as well; patterns are few
            p = 1 / (1 + np.exp(-(x @ w)))
            w -= 1.0 * (x.T @ ((p - probability) * weight) / weight.sum() + 1e-3 * w)
        return cls(w, table, share)

    def probability(self, key: str) -> float:
        if key not in self.known:
            kind, voted, shaped = parse(key)
            z = float((inputs(np.array([kind]), voted[None], shaped[None]) @ self.weights)[0])
            self.known[key] = 1 / (1 + np.exp(-z))
        return self.known[key]

    def spans(self, text: str) -> list[tuple[str, int, int, bool]]:
        return [s for s in proposed(text) if s[3] or self.probability(pattern(text, s)) >= ADD_FROM]


def fit(docs: DataFrame, text: str = "text") -> SpanClassifier:
    """Classifier from all proposals in all whole texts of ``docs``."""
    @F.pandas_udf("array<string>")
    def patterns(texts: pd.Series) -> pd.Series:
        return pd.Series([[pattern(t, s) for s in proposed(t)] if t else [] for t in texts])

    counts = docs.select(F.explode(patterns(F.col(text))).alias("key")).groupBy("key").count()
    return SpanClassifier.train({r[0]: int(r[1]) for r in counts.collect()})


def find(docs: DataFrame, model: SpanClassifier, text: str = "text") -> DataFrame:
    """``docs`` with spans array<struct<kind,start,end,base>> in order of start, then kind; offsets in code points.

    Rows stay where they are. Null and empty texts have no spans; repeated rows get equal ones; an empty table stays
    empty; a column named spans is replaced.
    """
    @F.pandas_udf("spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        names = ("kind", "start", "end", "base")
        return pd.DataFrame({"spans": [[dict(zip(names, s)) for s in model.spans(t)] if t else [] for t in texts]})

    return append(docs, found(F.col(text)), ["spans"])


def redact(docs: DataFrame, model: SpanClassifier, text: str = "text") -> DataFrame:
    """``docs`` whose ``text`` has every span replaced by its kind in brackets; overlapping spans are one. Null stays null."""
    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t, model.spans(t)) if t else t for t in texts], dtype=object)

    return docs.withColumn(text, cleaned(F.col(text)))


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b, _ in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
