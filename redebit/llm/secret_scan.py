"""Secret scan: fixed patterns, and formats inferred from what they find.

1. One pass over the texts records every base match and every other credential-like run of
   characters, with positions.
2. The matched values are the labelled credentials: an automaton per kind is learned from a
   bounded sample of distinct values (``EXAMPLES`` each, those with the smallest hashes), and
   one from ordinary words of the same texts.
3. Every candidate is scored by its format likelihood: mean log likelihood per character under
   the best credential automaton, less that under the word automaton. Those as likely as the
   learned credentials, and likelier than all example words, are added as kind ``format``.

Edge cases: a null text counts as empty and has no spans; without any credential in the table
nothing is added. Repeated rows are scanned one by one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redebit.llm.automata import learn
from redebit.llm.common import map_texts, stored

#: The base kinds in their order and the least length of each.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: A candidate: a run of credential characters with a digit and a letter, this long at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
WORD = re.compile(r"[A-Za-z+/_.=-]{8,}")
EXAMPLES = 1000
#: Longer values are not used as examples; they are scanned and scored like all others.
EXAMPLE_CHARS = 200
#: Share of learned credentials whose score may lie below the cutoff.
MISSED = 0.02


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base matches, by start, then kind as listed."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of credential-like runs that touch no base match."""
    found = []
    starts = [s for s, _, _, _ in spans]
    reach = list(accumulate((e for _, _, e, _ in spans), max))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)  # base matches that start before the run ends
        if not (before and reach[before - 1] > a) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            found.append((a, b, m[0]))
    return found


def scan(texts: Iterator[str]) -> dict[str, list]:
    out: dict[str, list] = {"base": [], "runs": [], "word": []}
    for text in texts:
        spans = base_spans(text)
        out["base"].append([{"start": a, "kind": k, "end": b, "value": v} for a, k, b, v in spans])
        out["runs"].append([{"start": a, "end": b, "value": v} for a, b, v in candidates(text, spans)])
        middle = WORD.search(text, len(text) // 2)
        out["word"].append(middle[0] if middle and not spans else None)
    return out


def scanned(docs: DataFrame) -> DataFrame:
    return map_texts(
        docs, ["doc_id"], scan,
        "base array<struct<start:int,kind:int,end:int,value:string>>, "
        "runs array<struct<start:int,end:int,value:string>>, word string",
    )


def examples(found: DataFrame, most: int = EXAMPLES) -> dict[int, list[str]]:
    """By kind, and -1 for words: at most ``most`` distinct values each, those of the smallest hashes."""
    values = found.select(F.explode("base").alias("b")).select("b.kind", "b.value").union(
        found.where("word IS NOT NULL").select(F.lit(-1).alias("kind"), F.col("word").alias("value"))
    )
    usable = values.where(F.length("value") <= EXAMPLE_CHARS).distinct().withColumn("h", F.xxhash64("value"))
    # Spread over hash blocks first, so that no task orders all values of a kind.
    near = Window.partitionBy("kind", F.pmod(F.col("h"), F.lit(64))).orderBy("h", "value")
    last = Window.partitionBy("kind").orderBy("h", "value")
    few = usable.withColumn("n", F.row_number().over(near)).where(F.col("n") <= most)
    few = few.withColumn("n", F.row_number().over(last)).where(F.col("n") <= most)
    out: dict[int, list[str]] = {}
    for r in few.select("kind", "value").collect():
        out.setdefault(r.kind, []).append(r.value)
    return out


class Formats:
    """Scores a string against the learned credential formats and ordinary words."""

    def __init__(self, by_kind: dict[int, list[str]]):
        self.kinds = [learn(v).scorer() for k, v in sorted(by_kind.items()) if k >= 0]
        words = by_kind.get(-1, [])
        self.words = learn(words).scorer()
        self.cutoff = float("inf")
        if self.kinds:
            known = sorted(self(v) for k, vs in by_kind.items() if k >= 0 for v in vs)
            self.cutoff = max([known[int(MISSED * len(known))], 0.0, *(self(w) for w in words)])

    def __call__(self, text: str) -> float:
        """Mean log likelihood per character above that of words; minus infinity with no format learned."""
        return max((k(text) for k in self.kinds), default=float("-inf")) - self.words(text)


def report(found: DataFrame, formats: Formats) -> DataFrame:
    """Per document: counts by kind, all spans as an array, the digests, and the best format score."""
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, "
        "format_score double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda spans: ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for base, runs in zip(batch.column("base").to_pylist(), batch.column("runs").to_pylist()):
                own = [(s["start"], s["kind"], s["end"]) for s in base]
                scores = [formats(r["value"]) for r in runs]
                more = [(r["start"], 3, r["end"]) for r, s in zip(runs, scores) if s >= formats.cutoff]
                named = lambda spans: [(a, (*KINDS, "format")[k], b) for a, k, b in sorted(spans)]
                base_text = text(named(own))
                row = (
                    *(sum(k == kind for _, k, _ in own) for kind in range(3)),
                    hashlib.sha256(base_text.encode()).hexdigest(), text(named(own + more)), len(more),
                    max(scores, default=None),
                )
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = (*[pa.int64()] * 3, pa.string(), pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, type=t) for c, t in zip(columns, kinds))],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    return found.select("doc_id", "base", "runs").mapInArrow(run, schema)


def learned(docs: DataFrame) -> Formats:
    """The formats of the credentials in ``docs``."""
    return Formats(examples(stored(scanned(docs))))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format, format_score."""
    found = stored(scanned(docs))
    return report(found, Formats(examples(found)))


def redact(docs: DataFrame, formats: Formats, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; null texts stay null."""
    names = docs.columns
    schema = docs.schema

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = [(a, b) for a, _, b, _ in base]
        spans += [(a, b) for a, b, v in candidates(text, base) if formats(v) >= formats.cutoff]
        out, done = [], 0
        for a, b in sorted(spans):
            if a >= done:
                out += [text[done:a], mask]
            done = max(done, b)
        return "".join([*out, text[done:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts = pa.array([clean(t.as_py()) for t in batch.column(at)], type=batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, schema)
