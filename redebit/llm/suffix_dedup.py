"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if it lies in a string of ``MATCH`` bytes that also starts anywhere else, in another text
or the same. The job never holds a suffix for every byte and never forms pairs.

**Suffixes.** Of each string of ``MATCH`` bytes one place is chosen by its content alone: the first of the
places in it whose next ``ANCHOR`` bytes hash least. Equal strings choose equal places, so only suffixes that
start at chosen places (about 1 in 136) are indexed: a sparse suffix array, ordered by the first
bytes and then by the hash of ``ANCHOR`` bytes, in which suffixes that agree that far are neighbours.

**Family.** Texts come in batches. A batch gets its suffix array; the array is merge-scanned with each
level of the family, which gives the suffixes that agree for ``ANCHOR`` bytes or more; then
equal-sized levels merge, so n batches stand in about log2(n) levels. Arrays are bucketed
tables: scan and merge are sort-merge joins without a shuffle.

**Exact check.** A chosen place stands for a run of strings, its region. Regions that occur
twice as a whole go as a whole. What is left is compared string by string, regions of one suffix together, at
most ``CHUNK_REGIONS`` in one group: a suffix with more is dealt to several groups, and of these
each sends the strings it has seen, once, to a second count. A passage in a third of all texts is many small
groups, and no group grows with the input.

Strings are compared by hashes of 128 bits (64 of the suffix and 64 of the string or region), texts by MD5.

Edge cases: a null text is empty. Texts under ``MATCH`` bytes keep everything. Repeated rows and equal texts
give a row each, and remove each other. A text with one byte over and over chooses nearly every place;
it costs more and is right. Texts of any length are hashed piece by piece. An empty table gives no rows;
a null doc_id keeps its row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.llm.common import stored

MATCH, ANCHOR, BATCHES = 400, 128, 4
#: Strings hashed at once; a longer text goes piece by piece.
PIECE = 1 << 18
#: Regions compared at once: some 5 MB of text and under 100 MB of hashes in a task.
CHUNK_REGIONS = 8192
#: Bits of the filters that keep rows without partner out of a shuffle: 2 MB, whatever the input.
SIEVE_BITS = 1 << 24

SUFFIXES = "key binary, batch int, suffix binary, anchor long, place int, first int, last int, region long"
REGIONS = "anchor long, chunk int, key binary, first int, back int, single boolean, chunks int, bytes binary"
FOUND = "key binary, first int, last int, one long, two long, open boolean"


def powers(seed: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte value, and the powers of an odd base and of its inverse modulo 2^64."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    base = int(rng.integers(0, 1 << 60)) * 8 + 3
    raised = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(count, b, np.uint64)
        p[0] = 1
        raised.append(np.multiply.accumulate(p))
    return values, *raised


class Hasher:
    """Hashes of any substrings of one piece of text, by differences of running sums."""

    tables: dict[int, tuple] = {}

    def __init__(self, data: np.ndarray, seed: int, longest: int) -> None:
        if seed not in self.tables or len(self.tables[seed][1]) < longest:
            self.tables[seed] = powers(seed, longest)
        values, up, self.down = self.tables[seed]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def chosen(data: np.ndarray, match: int, anchor: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, first, last, anchor hash, region hash) of the chosen places of a text, piece by piece.

    ``first`` and ``last`` are the first and last string of ``match`` bytes for which the place stands.
    """
    width = match - anchor + 1
    for at in range(0, len(data) - match + 1, piece):
        own = data[at : at + piece + match - 1]
        hashes = Hasher(own, 1, piece + match)
        start = np.arange(len(own) - anchor + 1)
        values = hashes.of(start, start + anchor)
        least = sliding_least(values, width)
        runs = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]]).tolist()
        found = []
        for low, high in zip(runs, runs[1:]):
            while low < high:
                place = low + int(values[low : low + width].argmin())
                last = min(high - 1, place)
                found.append((place, low, last))
                low = last + 1
        place, first, last = np.array(found).T
        other = Hasher(own, 2, piece + match)
        region = other.of(first, last + match) ^ ((place - first) * 2_654_435_761 + (last - first)).astype(np.uint64)
        yield place + at, first + at, last + at, values[place].view(np.int64), region.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (MD5 of the text) and data (its bytes)."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select("doc_id", F.unhex(F.md5(data)).alias("key"), data.alias("data"))


def suffixes(texts: DataFrame, match: int = MATCH, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """The suffixes at chosen places: text key, batch, first bytes, anchor hash, place and region."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for key, data in zip(batch.column(0), batch.column(1)):
                key, raw = key.as_py(), data.as_buffer()
                text = np.frombuffer(raw, np.uint8)
                for place, first, last, anchors, region in chosen(text, match, anchor):
                    n = len(place)
                    head = np.lib.stride_tricks.sliding_window_view(text, 8)[place]
                    yield pa.RecordBatch.from_arrays([
                        pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), pa.array([key], pa.binary())).dictionary_decode(),
                        pa.array(np.full(n, key[0] % batches), pa.int32()),
                        pa.array([x.tobytes() for x in head], pa.binary()), pa.array(anchors), pa.array(place, pa.int32()),
                        pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(region),
                    ], names=[x.split()[0] for x in SUFFIXES.split(", ")])

    long = texts.where(F.length("data") >= match).select("key", "data")
    return long.mapInArrow(gathered(run), SUFFIXES)


def gathered(run, rows: int = 8192):
    """``run`` with its many small batches put together."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += len(batch)
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return outer


class SuffixFamily:
    """Suffix arrays in levels of doubling size; each batch is scanned against all levels, then taken in."""

    ORDER = ("suffix", "anchor")

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.levels = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Anchors of the batch that occur twice in it, or in any level."""
        array = self.written(batch.groupBy(*self.ORDER).agg(F.count("*").alias("n")))
        table = self.spark.table(array)
        found = table.where("n > 1").select("anchor")
        for _, name in self.levels:
            found = found.unionByName(table.join(self.spark.table(name).select(*self.ORDER), [*self.ORDER]).select("anchor"))
        found = stored(found)
        size = 0
        while any(s == size for s, _ in self.levels):
            other = next(x for x in self.levels if x[0] == size)
            array, old = self.merge(other[1], array), array
            self.levels.remove(other)
            self.drop(other[1], old)
            size += 1
        self.levels.append((size, array))
        return found

    def merge(self, a: str, b: str) -> str:
        """Two sorted arrays as one: both sides are bucketed alike, so nothing is shuffled."""
        one, two = self.spark.table(a), self.spark.table(b).withColumnRenamed("n", "m")
        n = (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")
        return self.written(one.join(two, [*self.ORDER], "full").select(*self.ORDER, n))

    def written(self, array: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        array.write.bucketBy(self.buckets, *self.ORDER).sortBy(*self.ORDER).saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        self.drop(*(name for _, name in self.levels))
        self.levels = []


def sieve(values: DataFrame, column: str) -> DataFrame:
    """A bitmap of hashed values in rows of 4 KB; at most ``SIEVE_BITS`` bits."""
    place = sieve_place(F.col(column))
    bits = values.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("p"))
    return stored(bits.groupBy("_bucket").agg(F.bitmap_construct_agg("p").alias("_bits")))


def sieve_place(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SIEVE_BITS)) + 1


def sifted(rows: DataFrame, column: str, bits: DataFrame, present: bool = True) -> DataFrame:
    """Rows whose value may be in the sieve, or those whose value surely is not."""
    place = sieve_place(F.col(column))
    # At most SIEVE_BITS / 32768 rows of 4 KB, whatever the input: a broadcast of 2 MB.
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket", "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("0").cast("int") + F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 1
    return met.where(hit if present else ~hit).drop("_bucket", "_bits")


def shared_anchors(found: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Anchors of suffixes that agree with another, gathered batch by batch from a family of suffix arrays."""
    family = SuffixFamily(found.sparkSession)
    matches = [family.add(found.where(F.col("batch") == b)) for b in range(batches)]
    family.close()
    out = matches[0]
    for m in matches[1:]:
        out = out.unionByName(m)
    return stored(out.distinct())


def repeated_runs(texts: DataFrame, match: int = MATCH, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """key, first and last: runs of strings of ``match`` bytes that occur twice, by text."""
    every = stored(suffixes(texts, match, anchor, batches))
    shared = shared_anchors(every, batches)
    own = sifted(every.drop("suffix", "batch"), "anchor", sieve(shared, "anchor"))
    # Written before it is grouped: a join that feeds no grouping may split a hot suffix.
    own = stored(own.join(shared, "anchor", "left_semi"))
    kinds = stored(own.groupBy("anchor", "region").agg(
        F.count("*").alias("n"), F.first(F.struct("key", "place", "first", "last")).alias("sample")))
    # Suffixes with a region of their own: these regions are compared string by string, with one of each kind.
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("least = 1")
    mixed = mixed.select("anchor", F.ceil(F.col("kinds") / CHUNK_REGIONS).cast("int").alias("chunks"))
    open_regions = stored(kinds.join(mixed, "anchor").select(
        "sample.*", "anchor", (F.col("n") == 1).alias("single"), "chunks",
        F.pmod(F.xxhash64("region"), F.col("chunks")).cast("int").alias("chunk")))
    whole = own.join(kinds.where("n > 1").select("anchor", "region"), ["anchor", "region"], "left_semi")
    parts = string_runs(texts, open_regions, match)
    return whole.select("key", "first", "last").unionByName(parts)


def string_runs(texts: DataFrame, regions: DataFrame, match: int) -> DataFrame:
    """Runs of repeated strings of regions that do not repeat as a whole."""
    asked = regions.groupBy("key").agg(F.collect_list(F.struct("anchor", "chunk", "chunks", "single", "place", "first", "last")).alias("asked"))
    near = sifted(texts.select("key", "data"), "key", sieve(regions, "key")).join(asked, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] == before:  # a copy of the text above
                    continue
                before = r["key"]
                for a in r["asked"]:
                    first = a["first"]
                    out.append({k: a[k] for k in ("anchor", "chunk", "chunks", "single", "first")} | {
                        "key": before, "back": a["place"] - first, "bytes": r["data"][first : a["last"] + match]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("anchor", pa.int64()), ("chunk", pa.int32()), ("key", pa.binary()), ("first", pa.int32()), ("back", pa.int32()),
                ("single", pa.bool_()), ("chunks", pa.int32()), ("bytes", pa.binary())]))

    cuts = near.mapInArrow(cut, REGIONS)
    grouped = cuts.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk")
    found = stored(grouped.mapInArrow(gathered(lambda batches: compared(batches, match)), FOUND))
    seen = found.where("one is not null").groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    late = found.where("open").join(seen, ["one", "two"], "left_semi")
    return found.where("one is null").select("key", "first", "last").unionByName(late.select("key", "first", "last"))


def compared(batches: Iterator[pa.RecordBatch], match: int) -> Iterator[pa.RecordBatch]:
    """Groups of regions of one suffix: runs that repeat inside the group, and strings for the second count."""
    held, at = [], None
    for batch in batches:
        for r in batch.to_pylist():
            if (r["anchor"], r["chunk"]) != at:
                if held:
                    yield from compare_group(held, match)
                held, at = [], (r["anchor"], r["chunk"])
            held.append(r)
    if held:
        yield from compare_group(held, match)


def compare_group(regions: list[dict], match: int) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(r["bytes"]) for r in regions])
    strings = lengths - match + 1
    data = np.frombuffer(b"".join(r["bytes"] for r in regions), np.uint8)
    ends = np.cumsum(lengths)
    hashes = Hasher(data, 3, 1 << int(len(data)).bit_length())
    owner = np.repeat(np.arange(len(regions)), strings)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    start = (ends - lengths)[owner] + offset
    # The suffix lies in the same place of equal strings.
    back = np.array([r["back"] for r in regions])[owner] - offset
    value = hashes.of(start, start + match) ^ (back * 0x9E3779B1).astype(np.uint64)
    _, which, number, count = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
    single = np.array([r["single"] for r in regions])[owner]
    first = np.array([r["first"] for r in regions])[owner] + offset
    again = single & (count[number] > 1)
    keys = [r["key"] for r in regions]
    edge = np.diff(np.concatenate([[False], again, [False]]).astype(np.int8))
    # A run ends where the region does.
    turn = np.flatnonzero(again[1:] & again[:-1] & (owner[1:] != owner[:-1])) + 1
    low = np.sort(np.concatenate([np.flatnonzero(edge == 1), turn]))
    high = np.sort(np.concatenate([np.flatnonzero(edge == -1) - 1, turn - 1]))
    none = pa.nulls(len(low), pa.int64())
    yield found_batch([keys[i] for i in owner[low]], first[low], first[high], none, none, np.zeros(len(low), bool))
    if regions[0]["chunks"] > 1:
        # Each string once, for the count over all groups of the suffix.
        some = np.sort(which)
        suffix = pa.array(np.full(len(some), regions[0]["anchor"]), pa.int64())
        lone = single[some] & (count[number[some]] == 1)
        yield found_batch([keys[i] for i in owner[some]], first[some], first[some], suffix, pa.array(value[some].view(np.int64)), lone)


def found_batch(keys: list, first: np.ndarray, last: np.ndarray, one: pa.Array, two: pa.Array, lone: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), one, two, pa.array(lone, pa.bool_())],
        names=["key", "first", "last", "one", "two", "open"])


def merged_spans(first: np.ndarray, last: np.ndarray, match: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the strings cover."""
    spans: list[tuple[int, int]] = []
    for low, high in sorted(zip(first.tolist(), (last + match).tolist())):
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(high, spans[-1][1]))
        else:
            spans.append((low, high))
    return spans


def removed(docs: DataFrame, match: int = MATCH, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """doc_id, data, spans (start and end of the removed runs) and kept (the bytes that stay) of every row."""
    texts = keyed(docs)
    runs = stored(repeated_runs(texts, match, anchor, batches).distinct())
    by_text = runs.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    bits = sieve(runs, "key")
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, data binary, spans array<struct<start int, end int>>, kept binary"

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            spans, kept = [], []
            for data, own in zip(batch.column(1), batch.column(2)):
                text = memoryview(data.as_buffer())
                pairs = own.values
                found = [] if pairs is None else merged_spans(
                    pairs.field("first").to_numpy(), pairs.field("last").to_numpy(), match)
                ends = [0, *(x for span in found for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
                spans.append([{"start": a, "end": b} for a, b in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "data", "spans", "kept"])

    met = sifted(texts, "key", bits).join(by_text, "key", "left").select("doc_id", "data", "runs").mapInArrow(apply, schema)
    none = F.array().cast("array<struct<start int, end int>>")
    rest = sifted(texts, "key", bits, present=False).select("doc_id", "data", none.alias("spans"), F.col("data").alias("kept"))
    return met.unionByName(rest)


def dedup_documents(docs: DataFrame, **how: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the hash of what is kept."""
    rows = removed(docs, **how)
    size = F.length("data").cast("long")
    return rows.select(
        "doc_id", size.alias("n_bytes"), (size - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle(match: int = MATCH) -> str:
    """The same in SQL: every string of ``match`` bytes as a row."""
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    parts AS MATERIALIZED (SELECT r, c * 1024 AS base, length(h) // 2 AS n, substr(h, c * 2048 + 1, {2 * (1023 + match)}) AS h FROM d, range(length(h) // 2048 + 1) t(c)),
    strings AS MATERIALIZED (SELECT r, base + p AS p, md5_number(substr(h, 2 * p + 1, {2 * match})) AS m
        FROM parts, range(greatest(least(n - base - {match - 1}, 1024), 0)) t(p)),
    again AS (SELECT r, p FROM strings SEMI JOIN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1) USING (m)),
    marked AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + {match}, TRUE) AS begins FROM again),
    grouped AS (SELECT r, p, sum(begins::INTEGER) OVER (PARTITION BY r ORDER BY p) AS g FROM marked),
    spans AS MATERIALIZED (SELECT r, g, min(p) AS low, max(p) + {match} AS high FROM grouped GROUP BY r, g),
    pieces AS (SELECT r, g, coalesce(lag(high) OVER (PARTITION BY r ORDER BY g), 0) AS low, low AS high FROM spans
        UNION ALL SELECT d.r, coalesce(max(s.g), 0) + 1, coalesce(max(s.high), 0), length(any_value(h)) // 2 FROM d LEFT JOIN spans s USING (r) GROUP BY d.r),
    kept AS (SELECT r, sha256(unhex(string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY g))) AS kept_sha256 FROM pieces JOIN d USING (r) GROUP BY r),
    sums AS (SELECT r, sum(high - low) AS removed, count(*) AS spans FROM spans GROUP BY r)
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, kept_sha256
    FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)"""
