"""N-gram Jaccard join with set relations: which documents' word shingles overlap by 0.9 or more.

Method (sets of distinct shingles, 64-bit hashes; exact copies of a set are one set):

* Index. Tokens are ordered by how frequent their words are over all texts, rarest first (words
  are counted by hash bucket; a token's frequency is estimated by the product); a set's prefix
  in that order is indexed with size and position. Two sets that link share a prefix token.
  Tokens found in more than ``HEAVY`` prefixes (passages that many texts share) are put last in
  the order, and the sets concerned are indexed anew; so long lists remain only where whole
  sets are alike. Lists of one token are never expanded: entries that belong together form one
  block with bounds of size and position, and blocks are compared, so that a block whose
  bounds rule out the overlap is skipped whole.
* Answers. Sets that are much alike form a family around one of them, with the exact distance
  of each to it. Jaccard distance is a metric, so the distance of two family centres and the
  members' own distances settle most members' answers at once: families too far apart are
  skipped with all their pairs. Counts of tokens by hash bucket bound the overlap from above,
  so sets that are clearly too different are never fetched. What is left is counted exactly, family against family, in
  blocks of bounded size.
* Components. Each block pair gives link counts and a spanning forest of its links, never the
  pairs; components are the least labels over those forests.

Broadcast are one byte per hash bucket, and bitmaps of ``BITMAP`` bits that tell which tokens
are shared and which texts need their sets again; both have fixed sizes, and what passes a
bitmap by chance is dropped by the joins that follow.

Edge cases: null and empty texts have no shingles, link with nothing and are their own
component; a text with fewer words than a shingle is one shingle. Repeated rows are copies of
each other. A null doc_id can link, but a component is named by its smallest id that is not
null. 
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redebit.llm.common import SPACES, stored

WORDS, SIMILAR = 3, 90
#: Sets join a family when their similarity to its centre is at least this (percent).
FAMILY = 65
#: ... and only sets whose signatures allow this similarity are tried.
FAMILY_BOUND = 80
BUCKET_BITS, BITMAP = 20, 1 << 24
#: A stored bitmap is cut into pages of so many words, as powers of two.
PAGE_BITS = 9
#: Bounds of a block: sets, and tokens of all its sets (one longer set is a block of its own).
BLOCK_SETS, BLOCK_TOKENS = 256, 1 << 17
#: Longer words (bytes) are hashed one by one.
LONG_WORD = 64
#: Prefixes that hold a token before it counts as frequent, and rounds of indexing anew.
HEAVY, HEAVY_ROUNDS = 12, 4
#: Rows of an Arrow batch: a compared pair carries two whole sets, so the default of 10 000 would be some 100 MB a task.
BATCH_ROWS = 1000
#: Counters of a set's signature: tokens by the low bits of their hash.
COUNTERS = 128
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Bytes that belong to words, and masks of the lowest 0 to 8 bytes.
IN_WORD = np.isin(np.arange(256), list(SPACES.encode()), invert=True)
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all ``texts`` (no nulls), A-Z lower-cased, parted at the six ASCII white-space
    characters; and where each text's words begin, with the end of the last.

    A word up to ``LONG_WORD`` bytes is hashed eight bytes at a time, all words at once.
    """
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, ends = int(ends[0]), ends - ends[0]
    n = int(ends[-1])
    raw = (memoryview(data)[first : first + n].tobytes() if n else b"").lower() + bytes(8)  # of bytes: A-Z only
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IN_WORD[np.frombuffer(raw, np.uint8, n)]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    filled = ends[:-1] < ends[1:]  # words end with their text
    at, last = ends[:-1][filled], ends[1:][filled] - 1
    begins[at], stops[last] = inside[at + 1], inside[last + 1]
    at = np.flatnonzero(begins)
    sizes = np.flatnonzero(stops) + 1 - at
    eight = np.ndarray((n + 1,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    codes = sizes.astype(np.uint64) * ODD[0]
    left = np.flatnonzero(sizes <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        rest = sizes[left] - done
        part = eight[at[left] + done] & LOW_BYTES[np.minimum(rest, 8)]
        mixed = (codes[left] ^ part) * ODD[1 + done // 8 % 3]
        codes[left] = mixed ^ (mixed >> np.uint64(32))
        left = left[rest > 8]
        if not len(left):
            break
    codes = codes * ODD[0]  # the high bits name a word's bucket
    codes ^= codes >> np.uint64(29)
    codes *= ODD[3]
    for i in np.flatnonzero(sizes > LONG_WORD):
        codes[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i] + sizes[i]])
    return codes, np.searchsorted(at, ends)


def windows(codes: np.ndarray, words: int) -> np.ndarray:
    """Hash of each shingle, by position; the whole row where it is shorter than a shingle."""
    n = len(codes)
    width = min(words, n)
    mixed = np.full(n - width + 1 if n else 0, width, np.uint64)
    for j in range(width):
        mixed = (mixed ^ codes[j : n - width + 1 + j]) * ODD[j % len(ODD)]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def shingled(texts: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the hashes of its words, and those of its shingles by position."""
    codes, ends = word_codes(texts)
    every = windows(codes, words)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield codes[a:b], every[a : b - words + 1] if b - a >= words else windows(codes[a:b], words)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``."""
    return np.unique(next(shingled(pa.array([text]), words))[1])


def need(n: int) -> int:
    """Shared tokens that a set of ``n`` must have with any set it links to."""
    return -(-SIMILAR * n // 100)


def signature(own: np.ndarray) -> bytes:
    """Tokens of a set by the low bits of their hash."""
    return np.bincount((own & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype("<u4").tobytes()


def whole():
    return F.coalesce("text", F.lit("")).alias("text")


def text_hash():
    return F.xxhash64(whole()).alias("text_hash")


def word_counts(docs: DataFrame) -> DataFrame:
    """range and counts: words by hash bucket, a row per task and range of 2**12 buckets."""
    shift = np.uint64(64 - BUCKET_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 200):
                codes, _ = word_codes(batch.column(0).slice(at, 200))
                found, count = np.unique(codes >> shift, return_counts=True)
                total[found] += count
        parts = [(i, total[i << 12 : (i + 1) << 12]) for i in range(len(total) >> 12)]
        parts = [(i, c.astype("<i8").tobytes()) for i, c in parts if c.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=["range", "counts"]
        )

    return docs.select(whole()).mapInArrow(run, "range int, counts binary")


def bucket_classes(rows: DataFrame) -> np.ndarray:
    """One byte per bucket: six times the binary logarithm of the words counted there."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in pdf["counts"])
        level = np.minimum(np.log2(1 + total) * 6, 255).astype(np.uint8)
        return pd.DataFrame({"range": [pdf["range"].iloc[0]], "levels": [level.tobytes()]})

    # Each task gives one row per range, so a group has as many rows as there are tasks.
    sums = rows.groupBy("range").applyInPandas(add, "range int, levels binary")
    levels = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in sums.collect():  # 2**BUCKET_BITS bytes in all
        levels[r.range << 12 : (r.range + 1) << 12] = np.frombuffer(r.levels, np.uint8)
    return levels


def ordered_prefix(
    codes: np.ndarray, every: np.ndarray, levels: np.ndarray, heavy: np.ndarray, words: int
) -> tuple[np.ndarray, np.ndarray]:
    """A set, and its prefix in the global order: heavy tokens last, estimated frequency, then hash.

    ``codes`` are the text's words, ``every`` its shingles by position.
    """
    own, first = np.unique(every, return_index=True)
    word = levels[(codes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.int32)
    total = np.concatenate([[0], np.cumsum(word)])
    width = min(words, len(codes))
    frequency = (total[width:] - total[:-width])[first] + 4096 * hit(own.view(np.int64), heavy)
    order = np.argsort(frequency, kind="stable")  # ``own`` is sorted, so that ties go by hash
    return own, own[order[: len(own) - need(len(own)) + 1]]


INDEXED = "doc_id {}, n long, key binary, key_hash long, text_hash long, signature binary, token long, pos int"


def indexed(docs: DataFrame, levels: np.ndarray, heavy: np.ndarray, words: int) -> DataFrame:
    """Of rows (doc_id, text, text_hash) two kinds of rows: per text doc_id, n, key, text_hash and signature (token null); per prefix token, token, key, n, pos."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                tokens, keys, sizes, signatures = [], [], [], []
                for codes, every in shingled(part.column(1), words):
                    own, prefix = ordered_prefix(codes, every, levels, heavy, words) if len(codes) else (codes, codes)
                    tokens.append(prefix)
                    keys.append(hashlib.md5(own.tobytes()).digest() if len(own) else None)
                    signatures.append(signature(own) if len(own) else None)
                    sizes.append(len(own))
                lengths = [len(t) for t in tokens]
                of, n = np.repeat(np.arange(len(keys)), lengths), int(sum(lengths))
                ids, keys, sizes = part.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())
                none = lambda t, k: pa.nulls(k, t)
                marks = pa.array([int.from_bytes(k.as_py()[:8], "little", signed=True) if k.is_valid else None for k in keys], pa.int64())
                texts = [ids, sizes, keys, marks, part.column(2), pa.array(signatures, pa.binary()), none(pa.int64(), len(part)), none(pa.int32(), len(part))]
                places = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]) if n else np.empty(0, np.int32)
                entries = [
                    none(ids.type, n), sizes.take(pa.array(of)), keys.take(pa.array(of)), marks.take(pa.array(of)), none(pa.int64(), n), none(pa.binary(), n),
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(places),
                ]
                names = ["doc_id", "n", "key", "key_hash", "text_hash", "signature", "token", "pos"]
                yield pa.RecordBatch.from_arrays(texts, names=names)
                yield pa.RecordBatch.from_arrays(entries, names=names)

    return docs.mapInArrow(run, INDEXED.format(kind))


def index(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, key, text_hash, signature) and the entries (token, key, n, pos) that may be shared.

    Dropped are only entries whose token no second entry holds.
    """
    texts = docs.select("doc_id", whole(), text_hash())
    levels = bucket_classes(word_counts(docs))
    made = stored(indexed(texts, levels, np.zeros(BITMAP >> 3, np.uint8), words))
    own = made.where("token IS NULL").drop("token", "pos")
    entry = ["token", "key", "key_hash", F.col("n").cast("int").alias("n"), "pos"]
    entries = made.where("token IS NOT NULL").select(*entry)
    counts = stored(entries.select("token").groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    shared, heavy = [bitmap(counts, "token")], bitmap(counts.where(F.col("n") > HEAVY), "token")
    parts = [entries]
    heavy = either(heavy)
    for last in range(HEAVY_ROUNDS - 1, -1, -1):
        # Whoever has a heavy token in the prefix, of whatever round, is indexed anew; so is, alike everywhere, what a
        # bitmap takes for one. A prefix without heavy tokens is the same in the new order.
        keys = either(*(bitmap(passing(p, "token", heavy), "key_hash") for p in parts))
        marks = either(bitmap(passing(own, "key_hash", keys), "text_hash"))
        fresh = indexed(passing(texts, "text_hash", marks), levels, as_bytes(heavy), words)
        fresh = stored(passing(fresh.where("token IS NOT NULL").select(*entry), "key_hash", keys))
        parts = [passing(p, "key_hash", keys, False) for p in parts] + [fresh]
        new = either(bitmap(fresh, "token"))
        shared.append(new)
        if not last:
            break  # no round follows that would ask for new heavy tokens
        # Only tokens of fresh prefixes can have become heavy; they are counted over all prefixes.
        grown = fresh.select("token")
        for p in parts[:-1]:
            grown = grown.unionAll(passing(p, "token", new).select("token"))
        often = grown.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
        heavy = either(heavy, bitmap(often, "token"))
    possible = either(*shared)
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionAll(p)
    return own, stored(passing(entries, "token", possible).drop("key_hash"))


def shared_entries(entries: DataFrame) -> DataFrame:
    """Entries of the lists with two sets or more, with the list's least key as ``leader``; copies are one."""
    lists = entries.groupBy("token").agg(F.min("key").alias("leader"), F.max("key").alias("last"))
    lists = lists.where("leader <> last").drop("last")
    return entries.join(lists, "token").groupBy("token", "key").agg(
        F.first("n").alias("n"), F.first("pos").alias("pos"), F.first("leader").alias("leader")
    )


def bitmap(marks: DataFrame, column: str) -> DataFrame:
    """word, bits: the bitmap of the hashes in ``column``, as at most BITMAP / 64 rows that are not zero."""
    place = F.pmod(column, F.lit(BITMAP))
    bit = F.expr(f"shiftleft(1L, cast(pmod({column}, {BITMAP}) & 63 as int))")
    return marks.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def words_of(bits: DataFrame) -> DataFrame:
    """word, bits: the words of a stored bitmap that are not zero, or those of one that ``bitmap`` gives."""
    if "page" not in bits.columns:
        return bits
    return bits.select("page", F.posexplode("words")).select((F.shiftleft("page", PAGE_BITS) + F.col("pos")).cast("bigint").alias("word"), F.col("col").alias("bits")).where("bits <> 0")


def either(*maps: DataFrame) -> DataFrame:
    """The bits set in any of the bitmaps, stored as pages of ``1 << PAGE_BITS`` words: 2 MB in all, whatever was marked."""
    spark = maps[0].sparkSession
    every = spark.range(BITMAP >> 6).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    for m in maps:
        every = every.unionAll(words_of(m))
    merged = every.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    pages = merged.groupBy(F.shiftright("word", PAGE_BITS).cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("own"))
    return stored(pages.select("page", F.col("own.bits").alias("words")))


def as_bytes(bits: DataFrame) -> np.ndarray:
    out = np.zeros((BITMAP >> 6 >> PAGE_BITS, 1 << PAGE_BITS), np.int64)
    found = bits.toArrow()
    for page, words in zip(found.column("page").to_pylist(), found.column("words")):
        out[page] = words.values.to_numpy()
    return out.reshape(-1).view(np.uint8)


def passing(rows: DataFrame, column: str, bits: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows whose hash in ``column`` is in the bitmap, or is not; a bitmap has 512 pages, so it is broadcast."""
    table = F.broadcast(bits.select(F.col("page").alias("_page"), F.col("words").alias("_words")))
    word = F.shiftright(F.pmod(column, F.lit(BITMAP)), 6)
    met = rows.join(table, F.shiftright(word, PAGE_BITS).cast("int") == F.col("_page"), "left")
    own = F.get("_words", word.bitwiseAND((1 << PAGE_BITS) - 1).cast("int"))
    inside = own.bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod({column}, {BITMAP}) & 63 as int))")) != 0
    return met.where(F.coalesce(inside, F.lit(False)) == wanted).drop("_page", "_words")


def hit(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = hashes % BITMAP
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def needed_sets(docs: DataFrame, own: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """key and set of ``keys`` (distinct), worked out again from one text of each."""
    # The least text hash stands for a set.
    marks = own.join(keys, "key").groupBy("key").agg(F.min("text_hash").alias("text_hash"))
    texts = passing(docs.select(whole(), text_hash()), "text_hash", either(bitmap(marks, "text_hash"))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                found, sets = [], []
                for _, every in shingled(batch.column(0).slice(at, 200), words):
                    tokens = np.unique(every)
                    if len(tokens):
                        sets.append(tokens.tobytes())
                        found.append(hashlib.md5(sets[-1]).digest())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(sets, pa.binary())], names=["key", "set"])

    made = texts.mapInArrow(run, "key binary, set binary")
    return stored(made.join(keys, "key").groupBy("key").agg(F.first("set").alias("set")))


def compared(pairs: DataFrame, facts: DataFrame, fact: str, a: str, b: str, measure, name: str) -> DataFrame:
    """``pairs`` with ``name``: ``measure`` of the facts of the sets named in columns ``a`` and ``b``."""
    names = pairs.columns
    sided = pairs.join(facts.select(F.col("key").alias(a), F.col(fact).alias("fact_a")), a)
    sided = sided.join(facts.select(F.col("key").alias(b), F.col(fact).alias("fact_b")), b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [measure(x.as_py(), y.as_py()) for x, y in zip(batch.column("fact_a"), batch.column("fact_b"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(out, pa.float64())], names=[*names, name]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return sided.select(*names, "fact_a", "fact_b").mapInArrow(run, f"{kinds}, {name} double")


def similarity(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the exact ``jaccard``."""

    def measure(x: bytes, y: bytes) -> float:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(p, q, assume_unique=True))
        return both / (len(p) + len(q) - both)

    return compared(pairs, sets, "set", a, b, measure, "jaccard")


def similarity_bound(pairs: DataFrame, copies: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``at_most``, a bound of the similarity from the signatures."""

    def measure(x: bytes, y: bytes) -> float:
        p, q = np.frombuffer(x, "<u4").astype(np.int64), np.frombuffer(y, "<u4").astype(np.int64)
        both = np.minimum(p, q).sum()
        return both / (p.sum() + q.sum() - both)

    return compared(pairs, copies, "signature", a, b, measure, "at_most")


def centres(shared: DataFrame, copies: DataFrame) -> DataFrame:
    """key and to: the set that may be the centre of a set's family.

    Every set points to the least leader of its lists, but for those of few lists; pointers are followed to a set that
    points to itself, and kept where the signatures allow the similarity.
    """
    votes = stored(shared.groupBy("key", "leader").agg(F.count("*").alias("votes")))
    most = votes.groupBy("key").agg(F.max("votes").alias("most"))
    points = votes.join(most, "key").where("4 * votes >= most").groupBy("key").agg(F.min("leader").alias("to"))
    points = stored(points)
    step = points.select(F.col("key").alias("at"), F.col("to").alias("next"))
    for _ in range(3):
        points = points.join(step, F.col("to") == F.col("at")).select("key", F.col("next").alias("to"))
    roots = points.join(step, F.col("to") == F.col("at")).where("to = next AND key <> to").select("key", "to")
    return similarity_bound(roots, copies, "key", "to").where(F.col("at_most") >= FAMILY_BOUND / 100).select("key", "to")


def families(shared: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """key, n, family (a key) and d, the distance to it; a set unlike its centre is its own family."""
    near = similarity(roots, sets, "key", "to").where(F.col("jaccard") >= FAMILY / 100)
    sizes = shared.groupBy("key").agg(F.first("n").alias("n"))
    return sizes.join(near, "key", "left").select(
        "key", "n", F.coalesce("to", "key").alias("family"), F.coalesce(1 - F.col("jaccard"), F.lit(0.0)).alias("d")
    )


def near_families(shared: DataFrame, members: DataFrame, copies: DataFrame) -> DataFrame:
    """a, b, reach: pairs of different families that may hold a link by their blocks' bounds and signatures.

    ``reach`` is the distance of the centres up to which their members may link.
    """
    blocks = shared.join(members.select("key", "family"), "key").groupBy("token", "family").agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"), F.min(F.col("n") - F.col("pos")).alias("r0"),
        F.max(F.col("n") - F.col("pos")).alias("r1"),
    )
    x, y = blocks.alias("x"), blocks.alias("y")
    least = F.expr(f"{SIMILAR} * (x.n0 + y.n0) / {100 + SIMILAR}")  # overlap that the smallest sizes need
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.family") < F.col("y.family")) & F.expr(
        f"100 * x.n1 >= {SIMILAR} * y.n0 AND 100 * y.n1 >= {SIMILAR} * x.n0"
    ) & (F.least("x.r1", "y.r1") >= least - 1e-6))
    pairs = pairs.select(F.col("x.family").alias("a"), F.col("y.family").alias("b")).distinct()
    radii = members.groupBy("family").agg(F.max("d").alias("r"))
    close = similarity_bound(pairs, copies, "a", "b")
    close = close.join(radii.select(F.col("family").alias("a"), F.col("r").alias("ra")), "a")
    close = close.join(radii.select(F.col("family").alias("b"), F.col("r").alias("rb")), "b")
    close = close.withColumn("reach", F.expr(f"1 - {SIMILAR} / 100 + ra + rb + 1e-9"))
    return close.where("1 - at_most <= reach").select("a", "b", "reach")


def linked(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Boolean matrix of the links between two lists of sets, or within one."""
    both = left + (right or [])
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    tokens, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    often = count > 1
    place = np.cumsum(often) - 1
    inside = often[column]
    sizes = np.array([len(s) for s in both])
    shared = np.zeros((len(left), len(right if right is not None else left)))
    rows, columns, width = owner[inside], place[column[inside]], int(often.sum())
    for at in range(0, width, 8192):  # so many columns at a time, so that memory stays small
        part = (columns >= at) & (columns < at + 8192)
        dense = np.zeros((len(both), min(8192, width - at)), np.float32)
        dense[rows[part], columns[part] - at] = 1
        shared += dense[: len(left)] @ (dense[len(left) :] if right is not None else dense).T
    a, b = sizes[: len(left)], sizes[len(left) :] if right is not None else sizes
    shared = np.rint(shared)
    return 100 * shared >= SIMILAR * (a[:, None] + b[None] - shared)


def count_links(tasks: DataFrame) -> DataFrame:
    """key, links (documents), and ``to``: an edge of the spanning forest of the block pair's links.

    ``tasks``: task, side, key, copies, set; sorted so that a block pair's rows come together. Side 2 is a block that
    meets itself; blocks on sides 0 and 1 are different ones, and without one of them there is no link.
    """

    def solve(rows: list[tuple]) -> Iterator[tuple[bytes, int, bytes | None]]:
        sides = [[r for r in rows if r[0] == s] for s in (0, 1, 2)]
        sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in sides]
        if sides[2]:
            links = linked(sets[2], None)
            np.fill_diagonal(links, False)
            nodes = sides[2]
            near = links
        elif not sides[0] or not sides[1]:
            return
        else:
            links = linked(sets[0], sets[1])
            nodes = sides[0] + sides[1]
            near = np.zeros((len(nodes), len(nodes)), bool)
            near[: len(sides[0]), len(sides[0]) :] = links
            near |= near.T
        counts = near @ np.array([r[2] for r in nodes])
        seen = np.zeros(len(nodes), bool)
        for start in range(len(nodes)):
            if not seen[start]:
                seen[start] = True
                layer = near[start] & ~seen
                reached = layer.copy()
                while layer.any():
                    seen |= layer
                    layer = near[layer].any(0) & ~seen
                    reached |= layer
                for k in np.flatnonzero(reached):
                    yield nodes[k][1], int(counts[k]), nodes[start][1]
                if reached.any():
                    yield nodes[start][1], int(counts[start]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def done() -> pa.RecordBatch:
            found = list(solve(rows))
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))],
                names=["key", "links", "to"],
            )

        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                for row in zip(*(part.column(n).to_pylist() for n in ("task", "side", "key", "copies", "set"))):
                    if row[0] != current:
                        if rows:
                            yield done()
                        current, rows = row[0], []
                    rows.append(row[1:])
        if rows:
            yield done()

    return tasks.repartition("task").sortWithinPartitions("task", "side", "key").mapInArrow(
        run, "key binary, links long, to binary"
    )


def block_pairs(members: DataFrame, pairs: DataFrame, sets: DataFrame, copies: DataFrame) -> DataFrame:
    """task, side, key, copies, set: every member in each block pair that it takes part in."""
    counts = members.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("tokens") / BLOCK_TOKENS)).cast("int")
    sized = stored(counts.select("family", "sets", blocks.alias("blocks")))
    placed = members.join(sized, "family").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    all_blocks = lambda n: F.sequence(F.lit(0), n - 1)
    # Within a family: block i meets block j, i <= j; a block that meets itself is side 2.
    inner = placed.where("sets > 1").select(
        "key", F.col("family").alias("a"), F.col("family").alias("b"), "block",
        F.explode(all_blocks(F.col("blocks"))).alias("other"),
    ).select(
        "key", "a", "b", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"),
    )
    other = lambda end: sized.select(F.col("family").alias(end), F.col("blocks").alias("opposite"))
    sides = []
    for side, (own, opposite) in enumerate((("a", "b"), ("b", "a"))):
        met = pairs.join(other(opposite), opposite)
        rows = placed.select("key", F.col("family").alias(own), "block").join(met, own)
        rows = rows.withColumn("other", F.explode(all_blocks(F.col("opposite"))))
        i, j = ("block", "other") if side == 0 else ("other", "block")
        sides.append(rows.select("key", "a", "b", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side")))
    task = F.md5(F.concat("a", "b", F.encode(F.concat_ws(",", F.lit(""), "i", "j"), "utf-8")))
    rows = inner.unionByName(sides[0]).unionByName(sides[1]).select(task.alias("task"), "side", "key")
    return rows.join(copies, "key").join(sets, "key")


def least_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """key and label, the struct (id, key) that is least in each component of ``edges`` (key, to).

    Labels go to neighbours and then jump to the label of the label, until none changes.
    """
    both = stored(edges.select("key", "to").union(edges.select("to", "key")).distinct())
    labels = stored(nodes.select("key", F.struct("id", "key").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("key").alias("to"), "label"), "to").groupBy("key").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "key", "left").select(
            "key", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label")
        )
        nearer = stored(nearer)
        jump = nearer.select(F.col("key").alias("at"), F.col("label").alias("there"))
        after = stored(
            nearer.join(jump, F.col("label.key") == F.col("at"), "left").select(
                "key", "old", F.least("label", F.coalesce("there", "label")).alias("label")
            )
        )
        if after.where("old <> label").isEmpty():
            return after.select("key", "label")
        labels = after.select("key", "label")


def joined(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, key, text_hash) and sets (key, copies, links, id, component)."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    own, entries = index(docs, words)
    copies = stored(own.where("key IS NOT NULL").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("id"), F.first("signature").alias("signature")
    ))
    shared = stored(shared_entries(entries))
    roots = stored(centres(shared, copies))
    sets = needed_sets(docs, own, roots.select("key").union(roots.select("to")).distinct(), words)
    members = stored(families(shared, roots, sets))
    close = stored(near_families(shared, members, copies))
    more = close.select(F.col("a").alias("key")).union(close.select("b"))
    families_met = members.join(more.distinct().withColumnRenamed("key", "family"), "family", "left_semi").select("key")
    sets = sets.unionAll(needed_sets(docs, own, families_met.join(sets, "key", "left_anti"), words))
    pairs = stored(similarity(close, sets, "a", "b").where("1 - jaccard <= reach").select("a", "b"))
    answers = stored(count_links(block_pairs(members, pairs, sets, copies.select("key", "copies"))))
    links = answers.groupBy("key").agg(F.sum("links").alias("links"))
    edges = answers.where("to IS NOT NULL")
    labels = least_labels(copies.join(links, "key", "left_semi").select("key", "id"), edges)
    known = copies.join(links, "key", "left").join(labels, "key", "left").select(
        "key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label.id", "id").alias("id"),
        F.coalesce("label.key", "key").alias("component"),
    )
    return own, known


def join_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, n_links (other rows it links to)."""
    own, known = joined(docs, words)
    return own.join(known, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("component_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component: of its rows with the smallest doc_id, that of the least text hash.

    Texts without shingles link with nothing and all stay. Texts that a bitmap of the affected
    hashes rules out pass without a shuffle.
    """
    own, known = joined(docs, words)
    rows = own.where("key IS NOT NULL").join(known.select("key", "component"), "key")
    facts = stored(rows.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    groups = facts.groupBy("component").agg(F.min(first).alias("first"), F.sum("n").alias("all")).where("all > 1")
    decided = stored(
        facts.join(groups, "component").select(
            "text_hash", F.col("doc_id").alias("of"), (first == F.col("first")).alias("wins")
        )
    )
    bits = either(bitmap(decided, "text_hash"))
    hashed = docs.select(F.struct("*").alias("row"), "doc_id", text_hash())
    touched = lambda wanted: passing(hashed, "text_hash", bits, wanted)
    near = touched(True).withColumnRenamed("text_hash", "near_hash")
    near = near.join(
        decided, (F.col("near_hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("of")), "left"
    )
    winners = near.where("wins").dropDuplicates(["near_hash", "doc_id"])
    kept = near.where("wins IS NULL").unionAll(winners)
    return touched(False).select("row").unionAll(kept.select("row")).select("row.*")
