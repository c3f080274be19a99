"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of the training folds with quality 1; nothing else of the
labels is used. Unlabelled examples are documents of the same folds, whatever their label. A
first fit of positives against unlabelled text estimates the class prior from its best top
bin; the final fit minimises the non-negative unbiased risk under that prior.

Features are styles, not words: frequencies of character-class pairs and a few ratios over the
whole text, so they carry over between languages. Both samples are bounded
(``POSITIVES``, ``UNLABELLED`` documents, picked by a hash of the id); features and scores
cover every document.

Edge cases: a null text counts as empty and is scored like any other; a null doc_id is never
held out and never labelled; repeated rows are scored one by one. Without a trusted positive
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redebit.llm.common import in_fold, map_texts, stored

#: Bounds of the two samples.
POSITIVES = UNLABELLED = 10_000
FOLDS, HELD_OUT = 3, 1
#: Share of the negatives that may pass, so that positives at the edge do.
EDGE = 0.03
HIDDEN, EPOCHS, BATCH, RATE = 24, 25, 500, 0.003

#: Character classes by byte; the last one holds what is in no other.
CLASSES = (
    b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",",
    b"!?;:'\"-()", b"#*$%&|<>", bytes(range(128, 256)), b"",
)
CLASS_OF = np.full(256, len(CLASSES) - 1, np.intp)
for number, members in enumerate(CLASSES):
    CLASS_OF[list(members)] = number
WIDTH = len(CLASSES) ** 2 + 8


def features(text: str, compressor: zstandard.ZstdCompressor) -> np.ndarray:
    raw = text.encode()
    classes = CLASS_OF[np.frombuffer(raw, np.uint8)]
    pairs = np.bincount(classes[:-1] * len(CLASSES) + classes[1:], minlength=len(CLASSES) ** 2)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, size = max(len(words), 1), max(len(raw), 1)
    again = sum(map(bytes.__eq__, words[1:], words))
    style = (
        np.log1p(len(words)), len(raw) / n, len(set(words)) / n * np.log1p(n), again / n,
        1 - len(set(lines)) / max(len(lines), 1), len(lines) / n,
        len(compressor.compress(raw)) / size, max(map(len, words), default=0) ** 0.5,
    )
    return np.concatenate([np.sqrt(pairs / size), style]).astype(np.float32)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the feature vector of every whole text."""

    def measure(texts: Iterator[str]) -> dict[str, list]:
        compressor = zstandard.ZstdCompressor(level=1)
        return {"x": [features(t, compressor) for t in texts]}

    return map_texts(docs, ["doc_id"], measure, "x array<float>")


class Network:
    """One hidden layer of tanh units on standardised inputs; the output is a log odds."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.w = [
            rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
            rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
        ]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh(self.inputs(x) @ a + b) @ c + d[0]

    def gradient(self, z: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradient of sum(slope * output) over standardised inputs ``z``."""
        a, b, c, _ = self.w
        h = np.tanh(z @ a + b)
        back = np.outer(slope, c) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7) -> Network:
    """Minimise the non-negative unbiased risk under ``prior``; with None, positives against unlabelled."""
    net = Network(np.concatenate([positive, unlabelled]), seed)
    rng = np.random.default_rng(seed)
    p, u = net.inputs(positive), net.inputs(unlabelled)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.w]
    steps, t = max(1, max(len(p), len(u)) // BATCH), 0
    for _ in range(EPOCHS):
        for _ in range(steps):
            t += 1
            a, b = p[rng.integers(len(p), size=BATCH)], u[rng.integers(len(u), size=BATCH)]
            hidden = lambda z: np.tanh(z @ net.w[0] + net.w[1]) @ net.w[2] + net.w[3][0]
            fa, fb = hidden(a), hidden(b)
            # Logistic loss: -log sigmoid(f) as positive, -log sigmoid(-f) as negative.
            if prior is None:
                slope_a, slope_b = -sigmoid(-fa) / BATCH, sigmoid(fb) / BATCH
            else:
                negative = np.logaddexp(0, fb).mean() - prior * np.logaddexp(0, fa).mean()
                if negative >= 0:
                    slope_a = prior * (-sigmoid(-fa) - sigmoid(fa)) / BATCH
                    slope_b = sigmoid(fb) / BATCH
                else:  # the negative part overfits: step it back up
                    slope_a, slope_b = prior * sigmoid(fa) / BATCH, -sigmoid(fb) / BATCH
            grads = [x + y for x, y in zip(net.gradient(a, slope_a), net.gradient(b, slope_b))]
            for w, g, (m, v) in zip(net.w, grads, moments):
                g = g + 1e-4 * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled scores, from the top bin where the bound on it is least."""
    cuts = np.quantile(positive, np.linspace(0.01, 0.99, 99))
    q_p = (positive[:, None] >= cuts).mean(0)
    q_u = (unlabelled[:, None] >= cuts).mean(0)
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = np.argmin((q_u + slack) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.02, 0.98))


def sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of ``rows``, picked by a hash of doc_id."""
    share = min(1.0, 0.97 * most / max(rows.count(), 1))
    if share == 1.0:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) < int(share * 1_000_003)).limit(most)


def matrix(df: DataFrame) -> np.ndarray:
    table = df.select("x").toArrow().column("x").combine_chunks()
    return table.values.to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)


def train(found: DataFrame, labels: DataFrame) -> tuple[Network | None, float | None]:
    """The network and the estimated class prior, from the training folds of ``labels`` and ``found``."""
    own = found.where(~in_fold("doc_id", FOLDS, HELD_OUT) & F.col("doc_id").isNotNull())
    trusted = labels.where((F.col("quality") == 1) & ~in_fold("doc_id", FOLDS, HELD_OUT)).select("doc_id").distinct()
    # Bounded by POSITIVES ids.
    few = F.broadcast(sampled(trusted, POSITIVES, 1))
    positive = matrix(own.join(few, "doc_id", "left_semi").limit(4 * POSITIVES))
    unlabelled = matrix(sampled(own, UNLABELLED, 2))
    if not len(positive) or not len(unlabelled):
        return None, None
    half = lambda x, k: x[k::2] if len(x) > 1 else x
    first = fit(half(positive, 0), half(unlabelled, 0), None)
    prior = class_prior(first(half(positive, 1)), first(half(unlabelled, 1)))
    net = fit(positive, unlabelled, prior)
    # The clipped risk leaves the level of the output open: set it so that the share of unlabelled
    # text above zero is the class prior, with a little room for documents at the edge.
    net.w[3] -= np.quantile(net(unlabelled), (1 - prior) * (1 - EDGE))
    return net, prior


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted, class_prior."""
    found = stored(featured(docs))
    net, prior = train(found, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            score = np.full(len(batch), 0.5) if net is None else sigmoid(net(x.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = found.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select(
        "doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(prior).cast("double").alias("class_prior"),
    )
