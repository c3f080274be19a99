"""Centroid clustering over zone maps along a space-filling curve.

Vectors become integers. Their Hilbert index over the leading principal axes puts neighbours
next to each other; runs of ``BLOCK_ROWS`` neighbours form blocks that carry the least and
greatest value of every dimension, their count and their sum. A round looks at the box first:

* for centroids a and b, ``|x - a|^2 - |x - b|^2`` is linear in x, so its least value over the
  box is a sum over dimensions. Where it is above 0 (or 0 and b has the smaller number) no
  vector of the block can choose a; what is left are the block's candidate centroids;
* a block with one candidate gives its stored sum and count, and no vector is compared;
* the others compare their vectors with the candidates only, in exact integer arithmetic.

A task sends one row per centroid: count and sums. These are added by Spark, and the driver sees
as many rows as the centroids have components. Blocks are written once and reread by every round.

How much a box saves depends on the vectors. Where they form groups, most blocks keep one
candidate. The supplied vectors are almost the same in all directions (99.8 % of their spread
lies within their labels), most blocks do hold vectors of six or more clusters, and every
candidate is compared; the result is exact either way.

Edge cases: vectors that are null, of another length, or with null or non-finite components are
left out. Components are clamped to +-2^27 after scaling (131,072 before), so that squared
distances fit a long. Rows that share an id are vectors of their own; a null id is hashed as the
empty text and keeps its row. Equal distances go to the smaller number, equal vectors may be of
any number: the order of the curve is spread by the id. Fewer vectors than centroids give as many
centroids; an empty table gives no rows. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from redebit.llm.common import stored

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
LIMIT = 1 << 27
BLOCK_ROWS = 512
AXES, AXIS_BITS = 4, 10
#: With components below this, products and their sums over 64 dimensions are exact in a double.
EXACT = 1 << 21

BLOCKS = "ids array<long>, n long, data binary, low binary, high binary, total binary"
SUMS = "cluster int, n long, total array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the scaled integer components, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.size("embedding") == dimensions)
    scaled = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return own.where(finite).select("vec_id", scaled.alias("v"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of every row of ``cells`` (whole numbers of ``bits`` bits, one column per axis)."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    for level in range(bits - 1, 0, -1):  # undo what the curve turns and mirrors at each level
        mask = (1 << level) - 1
        for i in range(axes):
            mirrored = (x[:, i] >> level) & 1 == 1
            swap = np.where(mirrored, 0, (x[:, 0] ^ x[:, i]) & mask)
            x[:, 0] ^= np.where(mirrored, mask, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turned = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((x[:, -1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turned[:, None]
    index = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            index = (index << 1) | ((x[:, i] >> level) & 1)
    return index


def as_matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def axes_of(rows: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading principal axes and the range of the projections; sums of products, one row per task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(dimensions), np.zeros((dimensions, dimensions))
        for batch in batches:
            m = as_matrix(batch.column(1), dimensions).astype(float)
            n, total, products = n + len(m), total + m.sum(0), products + m.T @ m
        yield pa.record_batch({"m": [np.concatenate([[n], total, products.ravel()])]})

    # As many rows reach the driver as a matrix of the dimensions has cells, whatever the input.
    cells = rows.mapInArrow(moments, "m array<double>").select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("m"))
    n, *m = (r.m for r in cells.orderBy("pos").collect())
    axes = min(AXES, dimensions)
    if not n:
        return np.zeros((dimensions, axes)), np.zeros(axes), np.ones(axes)
    m = np.array(m)
    mean = m[:dimensions] / n
    spread = m[dimensions:].reshape(dimensions, dimensions) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(spread)
    lead = vectors[:, ::-1][:, :axes]
    reach = 3 * np.sqrt(np.maximum(values[::-1][:axes], 1e-9))
    return lead, mean @ lead - reach, 2 * reach


def blocks_along_curve(rows: DataFrame, dimensions: int = DIMENSIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of neighbours on the curve with their zone maps, written to the shared folder."""
    lead, low, reach = axes_of(rows, dimensions)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = (1 << AXIS_BITS) - 1
        for batch in batches:
            m = as_matrix(batch.column(1), dimensions)
            cells = np.clip((m @ lead - low) / reach * (top + 1), 0, top)
            place = pa.array(hilbert(cells, AXIS_BITS), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, place], names=["vec_id", "v", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rest = [], np.zeros((0, dimensions), np.int32)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rest = np.concatenate([rest, as_matrix(batch.column(1), dimensions)])
            while len(rest) >= block_rows:
                yield block(ids[:block_rows], rest[:block_rows])
                ids, rest = ids[block_rows:], rest[block_rows:]
        if ids:
            yield block(ids, rest)

    curve = rows.mapInArrow(indexed, "vec_id long, v array<int>, place long").withColumn("spread", F.xxhash64("vec_id"))
    # Equal vectors share a place on the curve; the id spreads them over tasks.
    ordered = curve.repartitionByRange("place", "spread").sortWithinPartitions("place", "spread")
    return stored(ordered.select("vec_id", "v").mapInArrow(cut, BLOCKS))


def block(ids: list, m: np.ndarray) -> pa.RecordBatch:
    cells = [m, m.min(0), m.max(0)]
    return pa.record_batch({
        "ids": pa.array([ids], pa.list_(pa.int64())), "n": pa.array([len(ids)], pa.int64()),
        **{k: pa.array([np.ascontiguousarray(c, np.int32).tobytes()], pa.binary()) for k, c in zip(("data", "low", "high"), cells)},
        "total": pa.array([m.sum(0, dtype=np.int64).tobytes()], pa.binary()),
    })


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that some vector of the box may choose.

    ``|x - a|^2 - |x - b|^2 = |a|^2 - |b|^2 + 2 x (b - a)``; each dimension takes its least value at
    an end of the box, so the bound is exact for whole numbers.
    """
    size = (centroids * centroids).sum(1)
    toward = 2 * (centroids[None, :, :] - centroids[:, None, :])  # [a, b] = 2 (b - a)
    least = size[:, None] - size[None, :] + np.minimum(toward * low, toward * high).sum(2)
    number = np.arange(len(centroids))
    beaten = (least > 0) | ((least == 0) & (number[None, :] < number[:, None]))
    return number[~beaten.any(1)]


def nearest(m: np.ndarray, centroids: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``some`` centroids and the squared distance; ties go to the smaller number."""
    c = centroids[some]
    if max(np.abs(m).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        m, c = m.astype(float), c.astype(float)
    else:
        m = m.astype(np.int64)
    distance = np.stack([((m - x) ** 2).sum(1) for x in c], 1)
    own = distance.argmin(1)
    return some[own], distance[np.arange(len(m)), own].astype(np.int64)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose seeded id hashes least (equal ids: by their components)."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def unpacked(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple]:
    """(ids, n, data, low, high, total) of the blocks of a batch; data and ids as functions, read when asked for."""
    ids, n, data, low, high, total = batch.columns
    for i in range(len(batch)):
        whole = lambda c, kind=np.int32: np.frombuffer(c[i].as_buffer(), kind)
        yield (lambda: ids[i].values), n[i].as_py(), (lambda: whole(data).reshape(-1, dimensions)), whole(low).astype(np.int64), whole(high).astype(np.int64), whole(total, np.int64)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact componentwise floor of the mean, empty ones as they were."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for _, n, data, low, high, whole in unpacked(batch, dimensions):
                some = candidates(low, high, centroids)
                if len(some) == 1:
                    count[some[0]] += n
                    total[some[0]] += whole
                    continue
                m = data()
                own, _ = nearest(m, centroids, some)
                for c in some:
                    mine = m[own == c]
                    count[c] += len(mine)
                    total[c] += mine.sum(0, dtype=np.int64)
        yield pa.record_batch({
            "cluster": pa.array(np.arange(k), pa.int32()), "n": pa.array(count, pa.int64()),
            "total": pa.array(list(total), pa.list_(pa.int64())),
        })

    sums = blocks.mapInArrow(run, SUMS).select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(
        F.sum("n").alias("n"), F.sum("col").alias("total"))
    after = centroids.copy()
    for r in sums.where("n > 0").collect():  # one row per centroid and dimension
        after[r.cluster, r.pos] = r.total // r.n
    return after


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, data, low, high, _ in unpacked(batch, dimensions):
                own, distance = nearest(data(), centroids, candidates(low, high, centroids))
                yield pa.record_batch({"vec_id": ids(), "cluster": pa.array(own, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return blocks.mapInArrow(run, ASSIGNED)


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
             dimensions: int = DIMENSIONS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Assigned vectors (vec_id, cluster, distance) and the final centroids."""
    rows = integers(vectors, dimensions, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], ASSIGNED), centroids
    blocks = blocks_along_curve(rows, dimensions, block_rows)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    return stored(assigned(blocks, centroids)), centroids


def cluster_vectors(vectors: DataFrame, **how: int) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = clusters(vectors, **how)
    inertia = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [
        Row(cluster=c, cluster_inertia=inertia.get(c, 0), inertia=sum(inertia.values()),
            centroid_sha256=hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest())
        for c, x in enumerate(centroids)
    ]
    kind = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    # One row per centroid, so the broadcast is as small as k.
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(facts, kind)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in SQL, a pair of tables per round."""
    steps = [
        f"""r AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
            WHERE len(embedding) = {DIMENSIONS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x::DOUBLE)]) = {DIMENSIONS})""",
        f"""v AS MATERIALIZED (SELECT r, vec_id, i, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS x
            FROM r, range(1, {DIMENSIONS + 1}) t(i))""",
        f"""s AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) - 1 AS c FROM r
            QUALIFY c < {k})""",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM v JOIN s USING (r))",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, c, d FROM (
            SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{n} c USING (i) GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(m, x) AS x FROM c{n} LEFT JOIN (
                SELECT c, i, ((t - ((t % n) + n) % n) // n)::BIGINT AS m
                FROM (SELECT a.c, v.i, sum(v.x)::BIGINT AS t, count(*) AS n FROM v JOIN a{n} a USING (r) GROUP BY ALL)) USING (c, i))""")
    ctes = ",\n".join(steps)
    return f"""WITH {ctes},
    h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    SELECT r.vec_id, a.c::INTEGER AS cluster, a.d AS distance,
        sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, h.centroid_sha256
    FROM a{rounds} a JOIN r USING (r) JOIN h ON h.c = a.c"""
