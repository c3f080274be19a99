"""Packing documents into token sequences: shortest-pack-first over the length histogram.

1. Each document is tokenised once; only per-piece facts (start, length, checksum) are kept.
   A document longer than a sequence is cut into full sequences and a rest.
2. The histogram of piece lengths has at most ``capacity`` rows, whatever the data. On it
   lengths are placed longest first, always into the open packs with the most room, for all
   documents of a length at once; a group of alike packs is one entry with a count.
3. Each placement says which ranks of a length go to which sequences at which offset. Pieces
   are numbered within their length in hashed blocks, so that a frequent length is spread over
   many tasks, and find their placement by that rank.

Edge cases: a null text counts as empty; an empty document still holds the closing id, so it
has one piece. Repeated rows each get their own piece. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from redebit.llm.common import stored

TOKENIZER = "word_bpe_49k.json"
CLOSING_ID = 2
CAPACITY = 4096
#: A capital I with a dot, the one letter whose lower case ends in a combining mark.
DOTTED = "\u0130".encode()
#: Words whose ids each Python worker remembers, and the longest kept from one group to the next.
CACHE_ROWS, CACHE_BYTES = 500_000, 64
#: Documents whose new words are encoded in one call.
GROUP = 128


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes, put together from its words.

    The tokenizer drops white space and never merges across it, so a text's ids are those of
    its words in order. Words of letters only are encoded in one call, which costs half as much.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.long: list[bytes] = []
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, words: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters only: one call, since each ends with its one end-of-word token."""
        text = b" ".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self.encode(words)
        raw, cuts = ids.tobytes(), (4 * stops).tolist()
        return [raw[i:j] for i, j in zip([0, *cuts], cuts)]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words not met before, which are remembered.

        A full stop or comma behind letters is parted from them, and ASCII letters are
        lower-cased, as the tokenizer does both; so fewer words need its call. A word that ends in
        ``DOTTED`` stays whole, since the tokenizer joins its dot and the mark.
        """
        known, letters, others, split = self.known, {}, [], []
        for word in words:
            mark = word[-1:]
            core = word[:-1] if mark == b"." or mark == b"," else word
            if core.isalpha():
                core = core.lower()
            elif core is word or not core.decode().isalpha() or core.endswith(DOTTED):
                if word.decode().isalpha():
                    letters[word] = None
                    split.append((word, word, b""))
                else:
                    others.append(word)
                continue
            split.append((word, core, b"" if len(core) == len(word) else mark))
            if core not in known:
                letters[core] = None
        own = dict(zip(others, self.encode(others))) if others else {}
        if letters:
            cores = list(letters)
            own.update(zip(cores, self.encode_letters(cores)))
        for mark in (b".", b","):
            if mark not in known:
                own[mark] = self.encode([mark])[0]
        marks = {b"": b"", **{m: known.get(m) or own[m] for m in (b".", b",")}}
        for word, core, mark in split:
            if word not in own:
                own[word] = (own[core] if core in own else known[core]) + marks[mark]
        if len(known) + len(own) > CACHE_ROWS:
            known.clear()
        known.update(own)
        self.long += [w for w in own if len(w) > CACHE_BYTES]
        return own

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        while self.long:
            self.known.pop(self.long.pop(), None)
        split = [t.encode().split() for t in texts]
        fresh = self.learn(set().union(*split).difference(self.known))
        for words in split:
            try:
                yield b"".join(map(self.known.__getitem__, words))
            except KeyError:  # the memory was emptied meanwhile
                missing = {w for w in words if w not in self.known and w not in fresh}
                fresh = {**fresh, **self.known, **(self.learn(missing) if missing else {})}
                yield b"".join(map(fresh.__getitem__, words))


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, closing_id: int = CLOSING_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: full sequences and a rest, each with the checksum of its ids."""
    schema = StructType.fromDDL(PIECES)
    schema["doc_id"].dataType = docs.schema["doc_id"].dataType
    arrow = to_arrow_schema(schema)
    closing = np.array([closing_id], "<u4").tobytes()

    def rows(ids: bytes) -> list[tuple[int, int, int, int]]:
        n = len(ids) // 4
        return [
            (a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * min(n, a + capacity)]), n)
            for a in range(0, n, capacity)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(public_tokenizers.path(tokenizer))
        for batch in batches:
            for at in range(0, len(batch), GROUP):
                part = batch.slice(at, GROUP)
                pieces = [rows(ids + closing) for ids in own.ids(part.column(1).to_pylist())]
                index = np.repeat(np.arange(len(part)), [len(p) for p in pieces])
                facts = np.array([r for p in pieces for r in p], np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(index)), *(pa.array(f) for f in facts)], schema=arrow
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def shortest_pack_first(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset) for a histogram (length, count).

    Lengths go longest first into the open packs with the most room that can take them. Packs
    filled alike form one group of consecutive sequences; filling a part of a group splits it.
    """
    room: list[int] = []  # room of the open groups, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, count)
    placed, sequences = [], 0

    def open_group(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in groups:
                groups[left] = []
                insort(room, left)
            groups[left].append((first, count))

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            if room and room[-1] >= length:
                most = room[-1]
                first, packs = groups[most].pop()
                if not groups[most]:
                    del groups[most]
                    room.pop()
                taken = min(packs, count - rank)
                open_group(most, first + taken, packs - taken)
            else:
                most, first, taken = capacity, sequences, count - rank
                if 2 * length <= capacity:  # several of this length fit into a fresh pack
                    taken = -(-taken // (capacity // length))
                sequences += taken
            placed.append((length, rank, taken, first, capacity - most))
            rank += taken
            open_group(most - length, first, taken)
    return placed


def ranked(pieces: DataFrame, blocks: int) -> DataFrame:
    """``pieces`` with ``rank``, numbering those of each length from 0.

    Rows are numbered within (length, hash block); the blocks' counts shift the numbers.
    """
    block = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks))
    cut = pieces.withColumn("block", block)
    counts = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    within = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    return (
        cut.withColumn("number", F.row_number().over(within))
        .join(shifts, ["length", "block"])
        .withColumn("rank", F.col("shift") + F.col("number") - 1)
        .drop("block", "number", "shift")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, blocks: int | None = None) -> DataFrame:
    """``pieces`` (at least doc_id, start, length, ids_crc32) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    blocks = blocks or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    histogram = [tuple(r) for r in pieces.groupBy("length").agg(F.count("*")).collect()]  # at most capacity rows
    placed = pd.DataFrame(
        shortest_pack_first(histogram, capacity), columns=["length", "first", "count", "sequence", "offset"]
    ).astype("int64")
    placed = placed.sort_values(["length", "first"], ignore_index=True)
    by_length = {k: g.to_numpy() for k, g in placed.groupby("length")}
    schema = StructType(pieces.schema.fields + StructType.fromDDL("sequence_id long, offset long").fields)
    arrow = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            out = np.zeros((2, len(batch)), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                own = by_length[value]
                slot = own[np.searchsorted(own[:, 1], rank[at], side="right") - 1]
                out[0, at] = slot[:, 3] + rank[at] - slot[:, 1]
                out[1, at] = slot[:, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-2]), *map(pa.array, out)], schema=arrow)

    return ranked(pieces, blocks).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, closing_id: int = CLOSING_ID, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(stored(cut_pieces(docs, tokenizer, closing_id, capacity)), capacity)


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens and padding; a sequence as long as a power of two needs none."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    power = F.expr("filled & (filled - 1)") == 0
    return filled.agg(
        F.count("*").alias("sequences"), F.sum("filled").alias("tokens"),
        F.sum(F.when(power, 0).otherwise(capacity - F.col("filled"))).alias("padding"),
    )
