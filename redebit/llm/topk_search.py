"""Exact top-k search by inner product with a three-phase uniform threshold.

Vectors are integers (floor of 64 times each component). Rows lie in blocks, the nodes; the
dimensions are dealt to ``LISTS`` lists, whose partial scores add up to the score.

1. Each node gathers, per query, the best entries of each of its lists and scores them in full.
   The k-th best of these over all nodes is a score that k candidates do reach: a safe cutoff.
2. The cutoff goes to every node. A candidate that reaches it has a partial score of at least
   ``cutoff / LISTS`` in some list, so entries beyond that uniform threshold suffice.
3. Of these the remaining partial scores are resolved exactly, and what reaches the cutoff is
   ranked.

A node never sends more than its best k entries of a query in phase 1, and in phase 3 only
entries that reach the cutoff. Queries meet vectors block by block.

Edge cases: rows with a null id, a null vector or null or non-finite components take no part.
Rows that share an id are separate candidates; a query leaves out its own row only, and gives
its ranks once per row. Shorter vectors count as padded with zeros. Ties go to the smaller
vec_id. Fewer than k candidates give them all. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redebit.llm.common import stored

SCALE, EVERY, K, LISTS = 64, 20, 20, 2
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: Row numbers: partition, block of the partition, place in the block.
PLACE_BITS, BLOCK_SHIFT = 13, 40

BLOCK = "block long, ids binary, rows binary, dim int, v binary"
NAMES = ["block", "ids", "rows", "dim", "v"]


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the integer components, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    own = own.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return own.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def packed(block: int, ids: np.ndarray, rows: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    cells = (block, ids.tobytes(), rows.tobytes(), v.shape[1], np.ascontiguousarray(v).tobytes())
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names=NAMES)


def matrix(lists: list) -> np.ndarray:
    width = max((len(x) for x in lists), default=0)
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def blocked(rows: DataFrame) -> DataFrame:
    """Blocks of up to ``BLOCK_ROWS`` rows of (vec_id, v); every row gets a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                own = batch.slice(at, BLOCK_ROWS)
                block = (part << BLOCK_SHIFT) | (number << PLACE_BITS)
                number += 1
                ids = own.column(0).to_numpy()
                yield packed(block, ids, block + np.arange(len(ids)), matrix(own.column(1).to_pylist()))

    return rows.mapInArrow(run, BLOCK)


def unpack(batch: pa.RecordBatch, i: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell = lambda n: batch.column(prefix + n)[i].as_py()
    ids, rows = (np.frombuffer(cell(n), np.int64) for n in ("ids", "rows"))
    return ids, rows, np.frombuffer(cell("v"), np.int64).reshape(len(ids), cell("dim"))


def query_blocks(blocks: DataFrame, every: int) -> DataFrame:
    """Blocks of the rows whose id is divisible by ``every``, numbered by ``q`` from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            v = matrix([x for _, _, m in waiting for x in m])
            rows = np.concatenate([r for _, r, _ in waiting])
            return packed(int(rows[0]), np.concatenate([i for i, _, _ in waiting]), rows, v)

        for batch in batches:
            for i in range(len(batch)):
                ids, rows, v = unpack(batch, i)
                wanted = ids % every == 0
                if wanted.any():
                    waiting.append((ids[wanted], rows[wanted], v[wanted]))
                if sum(len(w[0]) for w in waiting) >= QUERY_ROWS:
                    yield done()
                    waiting.clear()
        if waiting:
            yield done()

    own = stored(blocks.mapInArrow(run, BLOCK))
    numbers = own.select("block", (F.row_number().over(Window.orderBy("block")) - 1).cast("long").alias("q"))  # ids of blocks only
    return own.join(numbers, "block")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in doubles where every sum fits, else in 64-bit integers."""
    largest = lambda x: float(np.abs(x).max(initial=0))
    if largest(a) * largest(b) * max(a.shape[1], 1) < 2**53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return a @ b.T


def partial_scores(q: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Scores of all pairs by list; dimensions are dealt in turn."""
    dim = min(q.shape[1], v.shape[1])  # beyond it one of the two is zero
    return [products(q[:, i:dim:LISTS], v[:, i:dim:LISTS]) for i in range(LISTS)]


def met(blocks: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """Every block beside every query block; query columns are named q_*."""
    own = queries.select(*[F.col(n).alias(f"q_{n}") if n != "q" else F.col("q") for n in queries.columns])
    return blocks.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).join(own, "q")


def local_lists(pairs: DataFrame, k: int) -> DataFrame:
    """query (row number) and score: a node's best ``k`` exact scores among the heads of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                _, rows, v = unpack(batch, i)
                _, q_rows, q = unpack(batch, i, "q_")
                lists = partial_scores(q, v)
                own = q_rows[:, None] == rows[None]
                whole = sum(lists)
                head = np.zeros(whole.shape, bool)
                most = min(k + 1, len(rows))
                for scores in lists:
                    np.put_along_axis(head, np.argpartition(scores, -most, axis=1)[:, -most:], True, axis=1)
                head &= ~own
                at, column = np.nonzero(head)
                score = whole[at, column]
                order = np.lexsort((-score, at))
                first = np.searchsorted(at[order], at[order], side="left")
                kept = order[np.arange(len(order)) - first < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_rows[at[kept]]), pa.array(score[kept].astype(np.int64))], names=["query", "score"]
                )

    return pairs.mapInArrow(run, "query long, score long")


def sufficient(pairs: DataFrame) -> DataFrame:
    """query, query_id, vec_id, score of the entries that reach the query's cutoff (column ``q_cutoffs``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, rows, v = unpack(batch, i)
                q_ids, q_rows, q = unpack(batch, i, "q_")
                cutoff = np.array(batch.column("q_cutoffs")[i].as_py(), np.float64)[:, None]
                lists = partial_scores(q, v)
                beyond = np.logical_or.reduce([scores >= cutoff / LISTS for scores in lists])
                at, column = np.nonzero(beyond)
                score = sum(scores[at, column] for scores in lists)
                kept = (score >= cutoff[at, 0]) & (q_rows[at] != rows[column])
                at, column, score = at[kept], column[kept], score[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (q_rows[at], q_ids[at], ids[column], score.astype(np.int64))],
                    names=["query", "query_id", "vec_id", "score"],
                )

    return pairs.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def with_cutoffs(queries: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Query blocks with ``cutoffs``, a double per row: minus infinity where fewer than k candidates were seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows = np.frombuffer(batch.column("rows")[i].as_py(), np.int64)
                number = np.full(len(rows), batch.column("q")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), pa.array(np.arange(len(rows))), pa.array(rows)], names=["q", "at", "query"]
                )

    rows = queries.select("q", "rows").mapInArrow(run, "q long, at long, query long").join(cutoffs, "query", "left")
    entry = F.struct("at", F.coalesce("cutoff", F.lit(float("-inf"))).alias("cutoff"))
    lists = rows.groupBy("q").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # a block's rows
    return queries.join(lists.select("q", F.col("entries.cutoff").alias("cutoffs")), "q")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score."""
    blocks = stored(blocked(integers(vectors)))
    queries = stored(query_blocks(blocks, every))
    count = queries.count()
    if not count:
        return blocks.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    heads = local_lists(met(blocks, queries, count), k)
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    cutoffs = heads.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query").agg(
        F.min(F.when(F.col("n") == k, F.col("score"))).cast("double").alias("cutoff")
    )
    ready = with_cutoffs(queries, cutoffs)
    found = sufficient(met(blocks, ready, count))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


ORACLE = f"""
WITH n AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM n q JOIN n c ON q.own <> c.own WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
