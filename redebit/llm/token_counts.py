"""Token counts by prefix dynamic programming.

In byte-pair encoding the encoding of a prefix is the encoding of a shorter prefix plus one
token, and a row of tokens is an encoding exactly when every neighbouring pair is one. So one
pass over a text finds the last token of every prefix, and with it the exact token count of
every prefix: ``count[i] = count[start of the last token] + 1``. Whatever is asked later
(tokens of a prefix, the longest prefix within a budget) is read from the stored counts.

Text is first cut where no token can reach across: before a space mark, and around characters
that no longer token holds. Counts of such segments are remembered, since words recur.

Edge cases: a null text counts as empty and has no tokens. Characters outside the vocabulary
cost one token per UTF-8 byte, as the library's byte fallback does. Repeated rows are counted
one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redebit.llm.common import map_texts

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Segments remembered in each Python worker, and the longest one worth remembering.
CACHE_ROWS, CACHE_CHARS = 1_000_000, 64
#: Left tokens whose followers are remembered; at most the vocabulary and the single characters met.
PAIR_ROWS = 100_000
MARK = "▁"


class Remembered(dict):
    """Token counts of segments, worked out on first use; emptied when full."""

    def __init__(self, owner: PrefixCounter):
        self.owner = owner

    def __missing__(self, part: str) -> int:
        got = self.owner.segment(part)[-1] if part else 0
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_ROWS:
                self.clear()
            self[part] = got
        return got


class PrefixCounter:
    """Exact token counts of every prefix under one piece model."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        joined = [p for p in self.score if len(p) > 1]
        #: What longer tokens begin with: where a substring is none of these, no longer token starts there.
        self.begins = {p[:k] for p in joined for k in range(1, len(p))}
        inner = {c for p in joined for c in p}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in joined):
            raise ValueError("a token reaches across a space; segments would not be exact")
        self.alone = [c for c in "\n\t" if c not in inner]
        alone = "".join(map(re.escape, self.alone))
        self.parts = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs: dict[str, dict[str, bool]] = {}
        self.totals = Remembered(self)

    def merge(self, text: str) -> list[str]:
        """The encoding of a short string by its merges: best score first, leftmost on ties."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def follows(self, last: str, token: str) -> bool:
        """Whether ``token`` may follow ``last`` ("" at the start): their joint encoding is the two."""
        if last + token in self.score and last:
            return False
        return self.merge(last + token) == ([last, token] if last else [token])

    def segment(self, text: str) -> list[int]:
        """Token counts of the prefixes of length 1 to len(text) of a segment."""
        score, begins, pairs, n = self.score, self.begins, self.pairs, len(text)
        if len(pairs) > PAIR_ROWS:
            pairs.clear()
        counts, last = [0] + [-1] * n, [""] * (n + 1)
        for start in range(n):
            before, done = last[start], counts[start]
            known = pairs.get(before)
            if known is None:
                known = pairs[before] = {}
            for end in range(start + 1, n + 1):
                token = text[start:end]
                if token in score:
                    cost = 1
                elif end == start + 1:
                    cost = len(token.encode())
                elif token in begins:
                    continue
                else:
                    break
                if counts[end] < 0:
                    ok = known.get(token)
                    if ok is None:
                        ok = known[token] = self.follows(before, token)
                    if ok:
                        counts[end], last[end] = done + cost, token
                if token not in begins:
                    break
        return counts[1:]

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK)

    def total(self, text: str) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        if "  " in text or text[0] == " " or MARK in text:
            parts = self.parts.findall(self.marked(text))
        else:
            cut = text.replace(" ", f" {MARK}")
            for c in self.alone:
                cut = cut.replace(c, f" {c} ")
            parts = f"{MARK}{cut}".split(" ")
        return sum(map(self.totals.__getitem__, parts))

    def prefixes(self, text: str) -> np.ndarray:
        """counts[i]: tokens of the first i characters, for i from 0 to len(text)."""
        out = np.zeros(len(text) + 1, np.int32)
        if text:
            done, at = 0, 0
            for part in self.parts.findall(self.marked(text)):
                got = self.segment(part)
                out[max(at, 1) : at + len(part)] = np.array(got[1 if at == 0 else 0 :], np.int32) + done
                done, at = done + got[-1], at + len(part)
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens and whether they exceed ``limit``."""

    def measure(texts: Iterator[str]) -> dict[str, list]:
        own = counter(public_tokenizers.path(model))
        sizes, counts = [], []
        for text in texts:
            sizes.append(len(text.encode()))
            counts.append(own.total(text))
        return {"n_bytes": sizes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_texts(docs, ["doc_id"], measure, "n_bytes long, n_tokens long, over_limit boolean")


def prefix_table(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ``counts``: the token count of each prefix, element i for the first i characters."""

    def measure(texts: Iterator[str]) -> dict[str, list]:
        own = counter(public_tokenizers.path(model))
        return {"counts": [own.prefixes(t) for t in texts]}

    return map_texts(docs, ["doc_id"], measure, "counts array<int>")


def tokens_of_prefix(chars: Column | int, counts: str = "counts") -> Column:
    """Tokens of the first ``chars`` characters, from the stored counts; the whole text beyond its end."""
    at = chars if isinstance(chars, Column) else F.lit(chars)
    return F.element_at(counts, F.least(at + 1, F.size(counts)).cast("int"))


def prefix_within(budget: Column | int, counts: str = "counts") -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from the stored counts."""
    most = budget if isinstance(budget, Column) else F.lit(budget)
    return F.size(counts) - F.array_position(F.transform(F.reverse(counts), lambda n: n <= most), True)
