"""Quality rules: word statistics and zstandard compression bands.

Every text is compressed whole and in chunks that cover all its bytes, shorter ones in shorter
texts. Repetitive text compresses too well and random text too badly; how well ordinary prose
compresses depends on its length, so each length has its own limits.

Edge cases: a null text counts as empty. A text with fewer than ten words fails the base
rule. Texts under ``LIMITS[0][0]`` bytes have no band, since frame overhead rules there.
Repeated rows are judged one by one; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from redebit.llm.common import SPACES, map_texts

#: (bytes at least, lowest ratio, highest ratio) of whole texts; the last row that applies holds.
LIMITS = (
    (64, 0.40, 1.60),
    (128, 0.30, 1.30),
    (256, 0.26, 1.05),
    (512, 0.22, 0.85),
    (1024, 0.20, 0.72),
    (4096, 0.18, 0.68),
    (16384, 0.15, 0.65),
)
#: Chunks of this length, or a little more, have one band; shorter ones that of a text of their length.
CHUNK_BYTES, CHUNK_LOW, CHUNK_HIGH = 4096, 0.15, 0.70
#: (bytes of a text at least, bytes of its chunks); shorter texts are one chunk.
CHUNKS = ((512, 256), (4096, 1024), (16384, CHUNK_BYTES))
#: A rest shorter than this belongs to the chunk before it.
LEAST_REST = 256
#: A text is rejected when more than this share of its bytes lies in chunks outside their band.
BAD_CHUNK_SHARE = 0.25
LEVEL = 3
WINDOW = 5
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which occurs twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    spread, key, size = n - window + 1, codes, len(ids)
    key, top = codes[:spread], size
    for j in range(1, window):
        if top > (1 << 62) // size:  # number the windows so far anew, so that no code overflows
            _, key = np.unique(key, return_inverse=True)
            top = int(key.max()) + 1
        key, top = key * size + codes[j : j + spread], top * size
    ordered = np.argsort(key, kind="stable")
    same = key[ordered[1:]] == key[ordered[:-1]]
    twice = np.zeros(spread, bool)
    twice[ordered[1:][same]] = True
    twice[ordered[:-1][same]] = True
    ends = np.zeros(n + 1, np.int64)
    ends[:spread] += twice
    ends[window : window + spread] -= twice
    return int((np.cumsum(ends[:n]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines holding a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def band(n_bytes: int, limits=LIMITS) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for least, a, b in limits:
        if n_bytes >= least:
            low, high = a, b
    return low, high


def chunk_band(n_bytes: int) -> tuple[float, float]:
    return (CHUNK_LOW, CHUNK_HIGH) if n_bytes >= CHUNK_BYTES else band(n_bytes)


def chunk_ends(n: int) -> list[int]:
    """Where the chunks of a text of ``n`` bytes end; together they are the whole text."""
    size = max((c for least, c in CHUNKS if n >= least), default=n)
    ends = list(range(size, n + 1, size)) if size else []
    if ends and n - ends[-1] < LEAST_REST:
        ends.pop()
    return [*ends, n] if n else []


def ratios(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """Compressed size over size of the whole, and bytes and ratio of each chunk."""
    whole = len(compressor.compress(raw)) / len(raw) if raw else 0.0
    ends = chunk_ends(len(raw))
    if len(ends) == 1:
        return whole, [(len(raw), whole)]
    chunks = [(b - a, len(compressor.compress(raw[a:b])) / (b - a)) for a, b in zip([0, *ends], ends)]
    return whole, chunks


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, zstd_ratio double, n_chunks long, n_bad_chunks long"
)


def measure(texts: Iterator[str]) -> dict[str, list]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    out: dict[str, list] = {n: [] for n in names}
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for text in texts:
        raw = text.encode()
        words = raw.split()  # bytes part at exactly the six ASCII white-space characters
        n = len(words)
        repeats = repeated_words(words)
        failed = n < 10 or 100 * repeats > 20 * n
        whole, chunks = ratios(raw, compressor)
        low, high = band(len(raw))
        limits = [chunk_band(size) for size, _ in chunks]
        bad = [size for (size, r), (a, b) in zip(chunks, limits) if not a <= r <= b]
        kept = not failed and low <= whole <= high and sum(bad) <= BAD_CHUNK_SHARE * len(raw)
        row = (
            n, len(text) - sum(map(text.count, SPACES)), sum(raw.count(s) for s in SYMBOLS), duplicate_lines(text),
            repeats, failed, kept, whole, len(chunks), len(bad),
        )
        for name, value in zip(names, row):
            out[name].append(value)
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the word statistics, ``base_failed``, ``kept`` and the ratios behind it."""
    return map_texts(docs, ["doc_id"], measure, FIELDS)
