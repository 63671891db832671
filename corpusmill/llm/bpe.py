"""Byte-pair encoding and decoding by forced boundaries.

Two adjacent symbols that stand side by side in no vocabulary token can't end up in one token, so a word may be cut
there for certain. The fragments are encoded on their own and their ids are put together again; most fragments are short
and come again and again, so each task remembers them.
"""

from __future__ import annotations

import gc
import json
import os
import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import append

#: Chunks, and words inside longer chunks, that a task remembers; a store starts anew when it is full.
REMEMBERED = 400_000
#: Marks that the rules part from a word before them; it is checked that they do.
MARKS = ".,!?;:"
#: Symbols that are merged at a time.
CELLS = 1 << 18


class ForcedBoundaryBpe:
    """Encoder and decoder of a tokenizers file with a BPE model, a splitting rule and byte symbols.

    Normalising and splitting follow the file's own rules; cutting and merging are done here, for all new words of a batch
    at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rules, model = Tokenizer.from_file(path), spec["model"]
        self.normalizer, self.splitter = rules.normalizer, rules.pre_tokenizer
        suffix, vocab = model.get("end_of_word_suffix") or "", dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        # All special tokens at once: the leftmost place, there the longest one.
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]

        # Symbols are the vocabulary's single characters, with and without the sign of a word's end; -1 is none of them.
        chars = sorted({c for t in vocab for c in (t[:-len(suffix)] if suffix and t.endswith(suffix) else t)})
        self.inner, self.last = (np.full(0x110000, -1, dtype=np.int32) for _ in range(2))
        symbols = []
        for c in chars:
            for end, table in (("", self.inner), (suffix, self.last)):
                if c + end in vocab:
                    table[ord(c)] = len(symbols)
                    symbols.append(vocab[c + end])
        self.symbol_ids = np.array([*symbols, -1], dtype=np.int64)
        # Which symbols stand side by side inside a token: everywhere else a word is cut.
        self.beside = np.zeros((len(symbols) + 1, len(symbols) + 1), dtype=bool)
        for token in vocab:
            ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            body = token[:-len(suffix)] if ends else token
            s = [int(self.inner[ord(c)]) for c in body]
            if ends or not suffix:
                s[-1:] = [int(self.last[ord(body[-1])])]
            for x, y in zip(s, s[1:]):
                self.beside[x, y] = True
        # Ranks by pair of ids, sorted for search.
        self.width = max(vocab.values()) + 1
        known = [(vocab[x] * self.width + vocab[y], r, vocab[x + y]) for r, (x, y) in enumerate(pairs) if x in vocab and y in vocab and x + y in vocab]
        order = sorted({k: (k, r, m) for k, r, m in reversed(known)}.values())
        self.keys, self.ranks = np.array([k for k, _, _ in order]), np.array([r for _, r, _ in order])
        self.merged = np.zeros(len(pairs), dtype=np.int64)
        self.merged[self.ranks] = [m for _, _, m in order]
        self.none = len(pairs)

        self.chunks: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        # Most rules keep a run of letters together; then such a run needs no look at the rule.
        letters = string.ascii_letters
        normal = self.normalizer.normalize_str(letters)
        self.lowers = normal == letters.lower()
        self.whole_letters = normal.lower() == letters.lower() and all(
            [w for w, _ in self.splitter.pre_tokenize_str(normal + end)] == [normal, *end] for end in ("", *MARKS))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.none)

    def merge(self, rows: np.ndarray) -> np.ndarray:
        """Tokens of fragments of one length, each a row of symbol ids; rows end with -1 where they have become shorter.

        In each round the pair of lowest rank of every row is merged, the leftmost of equals, until no pair has a rank.
        """
        ranks = self.rank(rows[:, :-1], rows[:, 1:])
        live, place = np.arange(len(rows)), np.arange(rows.shape[1] + 1)
        while True:
            i = ranks[live].argmin(axis=1)
            best = ranks[live, i]
            live, i, best = (x[best < self.none] for x in (live, i, best))
            if not len(live):
                return rows
            n = np.arange(len(live))
            s = np.pad(rows[live], ((0, 0), (0, 2)), constant_values=-1)
            r = np.pad(ranks[live], ((0, 0), (0, 1)), constant_values=self.none)
            # Take out the right one of the pair, and the pair's rank; only the ranks beside the new symbol change.
            s = np.take_along_axis(s, place + (place > i[:, None]), 1)
            r = np.take_along_axis(r, place[:-2] + (place[:-2] >= i[:, None]), 1)
            s[n, i] = self.merged[best]
            inner = i > 0
            r[n[inner], i[inner] - 1] = self.rank(s[n[inner], i[inner] - 1], s[n[inner], i[inner]])
            more = i < r.shape[1]
            r[n[more], i[more]] = self.rank(s[n[more], i[more]], s[n[more], i[more] + 1])
            rows[live], ranks[live] = s[:, :-1], r

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word: cut at forced boundaries, fragments of one length encoded together, then concatenated."""
        ends = np.cumsum([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.inner[codes]
        symbols[ends - 1] = self.last[codes[ends - 1]]
        cut = np.ones(len(codes) + 1, dtype=bool)
        cut[1:-1] = ~self.beside[symbols[:-1], symbols[1:]]
        cut[ends] = True
        starts = np.flatnonzero(cut)
        starts, sizes = starts[:-1], np.diff(starts)
        ids = self.symbol_ids[symbols]
        for size in np.unique(sizes[sizes > 1]):
            of = starts[sizes == size]
            for k in range(0, len(of), max(1, CELLS // int(size))):
                cells = of[k:k + max(1, CELLS // int(size)), None] + np.arange(size)
                ids[cells] = self.merge(ids[cells])
        kept = ids >= 0
        counts = np.diff(np.concatenate([[0], np.cumsum(kept)[ends - 1]]))
        flat, at = ids[kept].tolist(), 0
        out = []
        for n in counts.tolist():
            out.append(tuple(flat[at:at + n]))
            at += n
        return out

    def learn(self, new: list[str]) -> None:
        """Remembers the ids of chunks: runs without blanks and line feeds."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        parts = []
        for chunk in new:
            if self.whole_letters and chunk.isascii() and chunk.isalpha():
                parts.append([chunk.lower() if self.lowers else chunk])
            elif len(chunk) > 1 and chunk[-1] in MARKS and self.whole_letters and chunk[:-1].isascii() and chunk[:-1].isalpha():
                parts.append([chunk[:-1].lower() if self.lowers else chunk[:-1], chunk[-1]])
            else:
                parts.append([w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))])
        missing = [w for w in {w for p in parts for w in p} if w not in self.words]
        if missing:
            self.words.update(zip(missing, self.encode_words(missing)))
        words = self.words
        for chunk, p in zip(new, parts):
            self.chunks[chunk] = words[p[0]] if len(p) == 1 else tuple(chain.from_iterable([words[w] for w in p]))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        # The rules treat white space alike and never join what it parts, so they are asked about unknown chunks only.
        split = [[(piece.replace("\n", " ").split(" "), token) for piece, token in self.pieces(t or "")] for t in texts]
        seen = set(chain.from_iterable(chunks for pieces in split for chunks, _ in pieces))
        if len(self.chunks) + len(seen) > REMEMBERED:
            self.chunks.clear()
        self.learn([c for c in seen if c not in self.chunks])
        out = []
        for pieces in split:
            ids: list[int] = []
            for chunks, token in pieces:
                ids += chain.from_iterable(map(self.chunks.__getitem__, chunks))
                if token is not None:
                    ids.append(token)
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def pieces(self, text: str):
        """The text between special tokens, each with the id of the token after it."""
        at = 0
        for found in self.marks.finditer(text) if self.marks else ():
            yield text[at:found.start()], self.special[found[0]]
            at = found.end()
        yield text[at:], None

    def decode(self, ids) -> str:
        """Vocabulary strings joined by a blank, as a file without decoder rules asks for."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids array<int> and decoded string. Rows stay where they are.

    ``path``: a tokenizers file that every executor finds. A null or empty text has no ids and decodes to the empty text.
    Special tokens in a text are encoded as such. Repeated rows get equal results; an empty table stays empty; input
    columns named ids or decoded are replaced.
    """
    @F.arrow_udf("ids array<int>, decoded string")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = ForcedBoundaryBpe(path)
        # Hundreds of thousands of remembered tuples hold no cycles; looking for some takes longer than encoding.
        gc.freeze()
        gc.set_threshold(1_000_000, 50, 50)
        for texts in batches:
            flat, ends, decoded = [], [0], []
            for ids in coder.encode_batch(texts.to_pylist()):
                flat += ids
                ends.append(len(flat))
                decoded.append(coder.decode(ids))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string())], ["ids", "decoded"])

    return append(docs, coded(F.col(text)), ["ids", "decoded"])


def default_path() -> str:
    """The public word-end vocabulary of the installed tokenizer files."""
    import public_tokenizers
    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))
