"""Toxicity by noisy-channel deobfuscation.

1. A character language model: letter trigrams of all texts, counted in the tasks; at most
   28**3 sums leave them.
2. A word outside the vocabulary of clean texts that may be obfuscated (letters with digits or
   signs, letters set apart, letters repeated) becomes a lattice: each character may stand for
   itself, for the letters it is used for, for a repetition, or for nothing; between letters set
   apart a word may end. Viterbi finds the likeliest letters under the language model and the
   channel's costs.
   A word is only decoded where some path of its lattice spells an entry of the lexicon, which a
   walk against the entries' trie tells; other words would weigh nothing whatever they say.
3. Restored words are scored by a lexicon of words and word beginnings from a bounded sample
   of labelled rows. One half of it gives a lexicon with which the other half fits how a
   text's word weights make its score. Every whole text is restored and scored.

Edge cases: a null text counts as empty; a text without words scores low; a null doc_id is
never held out and never labelled; repeated rows are scored one by one. Without labels of both
kinds every score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redebit.llm.common import in_fold, map_texts, stored

#: Bound of labelled rows of each kind that are used.
LABELLED = 10_000
FOLDS, HELD_OUT = 4, 2
CUTOFF = 0.3
#: Lengths of the word beginnings in the lexicon.
BEGINNINGS = (4, 5, 6)
#: Characters of the words remembered by each Python worker.
CACHE_CHARS = 4_000_000

#: The letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "h", "%": "o",
}
SEPARATORS = " .-_*~/\\"
#: Costs of the channel in natural logarithms.
SUBSTITUTED, REPEATED, DROPPED, LOST = 1.0, 0.3, 0.2, 8.0
#: Words of the vocabulary that are left as they stand, and the clean texts that must hold one.
KNOWN, KNOWN_TEXTS = 50_000, 3
LETTERS = 28  # 0: no letter, 1-26: a-z, 27: any other letter

CODES = np.zeros(256, np.int64)
CODES[list(b"abcdefghijklmnopqrstuvwxyz")] = range(1, 27)
CODES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = range(1, 27)
CODES[128:] = 27

#: Letters set apart by signs.
APART = re.compile(r"^[\w@$!|+€(#%](?:[.\-_*~/\\]+[\w@$!|+€(#%]){3,}$")
LETTER = re.compile(r"[^\W\d_]")
#: Without a digit, a sign or a letter twice in a row, the lattice leaves a word as it is.
CHANGEABLE = re.compile(r"[\W\d_]|([^\W\d_])\1")
#: Single characters with spaces between: a word spelled out.
SPELLED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
EDGES = ".,;:?\"'()[]{}<>#%&*|!$~`-_/\\"


def letter_trigrams(docs: DataFrame) -> DataFrame:
    """code, n: how often each letter trigram stands in all texts; at most 28**3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                texts = batch.column(0).slice(at, 256).to_pylist()
                c = CODES[np.frombuffer(("\n".join(texts) + "\n\n").encode(), np.uint8)]
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=len(total))
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total[codes])], names=["code", "n"])

    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "code long, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


class LetterModel:
    """log P(letter | two before), interpolated with shorter contexts."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape((LETTERS,) * 3).astype(float)
        one = tri.sum((0, 1)) + 1
        one /= one.sum()
        two = tri.sum(0)
        two = (two + 50 * one) / (two.sum(1, keepdims=True) + 50)
        self.log = np.log((tri + 20 * two[None]) / (tri.sum(2, keepdims=True) + 20)).tolist()

    @classmethod
    def of(cls, rows: list, words: dict[str, float] | None = None) -> LetterModel:
        """From trigram counts, with ``words`` (weights) given a twentieth of their mass."""
        counts = np.zeros(LETTERS**3)
        for r in rows:
            counts[r.code] = r.n
        if words:
            own = np.zeros(LETTERS**3)
            for word, weight in words.items():
                c = CODES[np.frombuffer(f" {word} ".encode(), np.uint8)]
                own += weight * np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=len(own))
            counts += own * (0.05 * counts.sum() + 1) / own.sum()
        return cls(counts)


def choices(c: str, apart: bool) -> list[tuple[str, float]]:
    """Letters that a character may stand for, with their costs; "" is nothing.

    Where letters are set apart, what stands between them is nothing; a sign elsewhere is
    rather a letter than nothing.
    """
    if apart and c in SEPARATORS:
        return [("", DROPPED)]
    found = [(c, 0.0)] if c.isalpha() else []
    found += [(x, SUBSTITUTED) for x in LEET.get(c, "")]
    if not c.isalnum():
        found.append(("", LOST if found else DROPPED))
    return found or [("", DROPPED)]


def code_of(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


def decode(word: str, model: LetterModel, apart: bool = False) -> str:
    """The likeliest letters behind ``word`` (Viterbi over the last two letters).

    A character equal to the one before may also count as its repetition and add nothing. Where
    letters are set apart, words may end between them; these have a space between them.
    """
    log = model.log
    # Letters are chains (letters before, letter), so that the work grows with the length only.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for c in word:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def reach(state: tuple[int, int], value: float, letters: tuple | None) -> None:
            if state not in after or value > after[state][0]:
                after[state] = (value, letters)

        options = choices(c, apart)
        ends = apart and c in SEPARATORS
        for (a, b), (value, letters) in states.items():
            if c == before and letters:
                reach((a, b), value - REPEATED, letters)
            for letter, cost in options:
                if letter:
                    k = code_of(letter)
                    reach((b, k), value - cost + log[a][b][k], (letters, letter))
                else:
                    reach((a, b), value - cost, letters)
                    if ends and b:
                        reach((b, 0), value - cost + log[a][b][0], (letters, " "))
        states, before = after, c
    chain = max(((v + log[a][b][0], s) for (a, b), (v, s) in states.items()), key=lambda e: e[0])[1]
    out = []
    while chain:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out)).strip()


def plain(word: str) -> str:
    return word.strip(EDGES).lower()


class Trie:
    """Words and beginnings of a lexicon, letter by letter; entries with other signs stand behind no lattice."""

    def __init__(self, entries: Iterable[str]):
        self.root: dict = {}
        for entry in entries:
            kind, letters = ("=", entry[1:]) if entry[0] == "=" else ("*", entry[:-1])
            if letters.isalpha():
                node = self.root
                for letter in letters:
                    node = node.setdefault(letter, {})
                node[kind] = True

    def spells(self, word: str, apart: bool = False) -> bool:
        """Whether some path of the lattice of ``word`` spells an entry, or starts with a beginning.

        Never False where ``decode`` could find an entry: a word may start after each separator
        of letters set apart, and a path that goes on past it stands for the words as one.
        """
        nodes, before = [self.root], ""
        for c in word:
            after: dict[int, dict] = {}
            if apart and c in SEPARATORS:
                if any("=" in n for n in nodes):
                    return True
                after[id(self.root)] = self.root
            elif c == before:
                after.update((id(n), n) for n in nodes)
            for letter, _ in choices(c, apart):
                for node in nodes:
                    to = node.get(letter) if letter else node
                    if to is not None:
                        if "*" in to:
                            return True
                        after[id(to)] = to
            if not after:
                return False
            nodes, before = list(after.values()), c
        return any("=" in n for n in nodes)


def restored(
    word: str, model: LetterModel, known: frozenset[str] = frozenset(), trie: Trie | None = None
) -> str | None:
    """What stands behind a word that may be obfuscated, several words with spaces; None for ``known`` and unchangeable words.

    With a ``trie`` also None where no path of the lattice spells one of its entries.
    """
    low = word.lower().rstrip(".,;:?!\"'")
    if len(low) < 3 or plain(word) in known or not LETTER.search(low) or not CHANGEABLE.search(low):
        return None
    apart = APART.match(low) is not None
    if trie is not None and not trie.spells(low, apart):
        return None
    return decode(low, model, apart)


def behind(word: str, model: LetterModel, known: frozenset[str] = frozenset(), trie: Trie | None = None) -> list[str]:
    """The words that stand behind one, and all of them as one."""
    found = (restored(word, model, known, trie) or "").split()
    return [*found, "".join(found)] if len(found) > 1 else found


def spelled(text: str) -> list[str]:
    """Words that are spelled out with spaces, put together again."""
    return [m[0].replace(" ", ".") for m in SPELLED.finditer(text)]


def keys(word: str) -> list[str]:
    """A word and its beginnings, as the lexicon lists them."""
    return [f"={word}", *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """text, toxic, half: the sampled labelled rows of the training folds; and how many there are of each kind."""
    known = labels.where(~in_fold("doc_id", FOLDS, HELD_OUT) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = []
    for kind in (0, 1):
        share = min(1.0, 0.97 * LABELLED / max(counts.get(kind, 0), 1))
        draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1
        parts.append(known.where((F.col("toxic") == kind) & draw).limit(LABELLED))
    # Bounded by 2 * LABELLED rows.
    few = F.broadcast(parts[0].union(parts[1]))
    half = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)).cast("int")
    return stored(docs.select("doc_id", "text").join(few, "doc_id").select("text", "toxic", half.alias("half"))), counts


def vocabulary(sample: DataFrame) -> frozenset[str]:
    """The changeable words of clean sampled texts that toxic ones do not hold more often; at most KNOWN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                totals[toxic].update({w for w in map(plain, set((text or "").split())) if LETTER.search(w) and CHANGEABLE.search(w)})
        words = list(totals[0] | totals[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([t[w] for w in words], pa.int64()) for t in totals)],
            names=["word", "clean", "toxic"],
        )

    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sums = sample.select("text", "toxic").mapInArrow(run, "word string, clean long, toxic long")
    sums = sums.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = sums.where((F.col("clean") >= KNOWN_TEXTS) & (F.col("toxic") * n.get(0, 0) <= F.col("clean") * n.get(1, 0)))
    return frozenset(r.word for r in sums.orderBy(F.desc("clean"), "word").limit(KNOWN).collect())


def lexicon(sample: DataFrame, model: LetterModel, known: frozenset[str] = frozenset(), most: int = 5000) -> dict[str, float]:
    """Log odds of the words and beginnings that speak most clearly for toxic texts.

    The odds are lowered by their standard error, so that rare words need more contrast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {w: None for w in (text or "").split()}
                found = {plain(w) for w in words}
                found |= {x for w in words for x in behind(w, model, known)} | {x for w in spelled(text or "") for x in behind(w, model)}
                totals[toxic].update({k for w in found if len(w) > 2 for k in keys(w)})
        all_keys = list(totals[0] | totals[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(all_keys, pa.string()), *(pa.array([t[k] for k in all_keys], pa.int64()) for t in totals)],
            names=["key", "clean", "toxic"],
        )

    sums = sample.select("text", "toxic").mapInArrow(run, "key string, clean long, toxic long")
    sums = sums.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    sure = (odds - 1.5 * spread).alias("weight")
    rows = sums.where(F.col("toxic") >= 3).select("key", "toxic", sure).where("weight > 1")
    return {r.key: r.weight for r in rows.orderBy(F.desc("weight"), F.desc("toxic"), "key").limit(most).collect()}


class Weights(dict):
    """Weight of every raw word, worked out on first use; emptied when full."""

    def __init__(self, lexicon: dict[str, float], model: LetterModel, known: frozenset[str] = frozenset()):
        self.lexicon, self.model, self.known, self.trie = lexicon, model, known, Trie(lexicon)
        self.chars = 0

    def of(self, word: str) -> float:
        return max((self.lexicon.get(k, 0.0) for k in keys(word)), default=0.0) if len(word) > 2 else 0.0

    def __missing__(self, raw: str) -> float:
        got = max(self.of(plain(raw)), *map(self.of, ["", *behind(raw, self.model, self.known, self.trie)]))
        if self.chars > CACHE_CHARS:
            self.clear()
            self.chars = 0
        if len(raw) < 64:
            self[raw] = got
            self.chars += len(raw) + 16
        return got

    def run(self, raw: str) -> list[float]:
        """The weights of all words of a spelled-out run."""
        return [self.of(w) for w in behind(raw, self.model)]


def summary(text: str, weights: Weights) -> tuple[float, float, float, float]:
    """Of the word weights: the largest, the sum of the three largest, how many are large, and per word."""
    words = text.split()
    got = np.fromiter(map(weights.__getitem__, words), float, len(words))
    if SPELLED.search(text):
        got = np.concatenate([got, *(weights.run(w) for w in spelled(text))])
    if not len(got):
        return 0.0, 0.0, 0.0, 0.0
    top = np.partition(got, -3)[-3:] if len(got) > 3 else got
    large = float((got > 2).sum())
    return float(top.max()), float(top.sum()), math.log1p(large), large / len(got)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps; the last entry is the constant."""
    z = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    ridge = np.full(len(b), 0.05 * weight.sum() / len(weight))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * b
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list, np.ndarray | None, frozenset[str]]:
    """Lexicon, trigram counts, regression weights and the vocabulary."""
    rows = letter_trigrams(docs).collect()  # at most 28**3
    sample, counts = labelled(docs, labels)
    first = LetterModel.of(rows)
    known = vocabulary(sample)
    words = lexicon(sample.where("half = 0"), first, known)
    own = LetterModel.of(rows, {k[1:]: w for k, w in words.items() if k[0] == "="})
    if not words:
        return {}, rows, None, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(words, own, known)
        for batch in batches:
            x = [summary(t or "", weights) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    kind = sample.schema["toxic"].dataType.simpleString()
    fitted = sample.where("half = 1").select("text", "toxic").mapInArrow(run, f"toxic {kind}, x array<double>").limit(8 * LABELLED).collect()
    y = np.array([r.toxic for r in fitted], float)
    if not 0 < y.sum() < len(y):
        return {}, rows, None, known
    # Each kind weighs as it does among all labelled rows of the training folds.
    share = np.where(y == 1, counts.get(1, 0) / y.sum(), counts.get(0, 0) / (len(y) - y.sum()))
    # How weights make a score was fitted on rows the lexicon had not seen; the final one may see them all.
    return lexicon(sample, first, known), rows, logistic(np.array([r.x for r in fitted]), y, share / share.mean()), known


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: ``keep``, held_out, score (0 to 1), predicted."""
    words, rows, beta, known = train(docs, labels)
    own = LetterModel.of(rows, {k[1:]: w for k, w in words.items() if k[0] == "="})

    def measure(texts: Iterator[str]) -> dict[str, list]:
        if beta is None:
            return {"score": [0.0 for _ in texts]}
        weights = worker_weights(words, own, known)
        x = np.array([summary(t, weights) for t in texts]).reshape(-1, 4)
        return {"score": 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))}

    scored = map_texts(docs, list(keep), measure, "score double")
    return scored.select(
        *keep, in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"),
    )


LAST: list = []


def worker_weights(words: dict[str, float], model: LetterModel, known: frozenset[str]) -> Weights:
    """The weights of this task's lexicon; kept between batches and tasks that share it."""
    mark = hash((frozenset(words.items()), known))
    if not LAST or LAST[0] != mark:
        LAST[:] = [mark, Weights(words, model, known)]
    return LAST[1]
