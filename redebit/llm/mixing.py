"""Mixing sources to target weights by hash-threshold histograms, in native operations.

Targets share all words by weight; a source gives at most ``MOST`` times its size and the
excess is reshared. A source's target is so many whole copies of it plus a rest; which
documents are taken once more is decided by a hash threshold: words are summed by source and
hash bucket, the bucket in which the rest runs out is cut into finer buckets, and so on for
``LEVELS`` levels. Only that boundary bucket is looked at again, and nothing is sorted: each
document is kept or not by comparing its hash with its source's threshold.

The hash is that of the document id, so reruns agree. Sums are combined before they are
shuffled, so a source that holds a third of all rows is no larger than the others.

Edge cases: a null text has size 0, a null source is a source of its own (last in order),
rows with the same id share their fate, a source of size 0 has target 0. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redebit.llm.common import stored

#: Weights repeat over the sources in code point order.
WEIGHTS = (1, 2, 3)
#: Times a document may be taken.
MOST = 3
#: Bits of a level and number of levels: the finest bucket holds 1 of 2**36 ids.
BITS, LEVELS = 12, 3


def n_words(text: Column) -> Column:
    """Runs of characters other than space and the five ASCII controls from tab to carriage return."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def place(doc_id: Column) -> Column:
    """The document's place in [0, 2**36): the first nine hexadecimal digits of the id's MD5."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4)
    return F.conv(digits, 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place"))


def weighted(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` by code point order, null last.

    Sources are numbered within ranges, and the ranges' counts shift the numbers.
    """
    ranges = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranges = stored(ranges)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    within = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    numbered = ranges.withColumn("number", F.row_number().over(within)).join(shifts, "range")
    weights = F.array(*map(F.lit, WEIGHTS))
    index = F.pmod(F.col("shift") + F.col("number") - 1, F.lit(len(WEIGHTS))) + 1
    return numbered.select("source", "source_size", F.element_at(weights, index.cast("int")).cast("long").alias("weight"))


def with_targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: shares by weight, capped, the excess reshared.

    Each round takes three sums over the sources; rounds end when no share is above its cap.
    """
    whole, cap = F.lit(None).cast("double"), F.col("source_size") * MOST
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    rest, weight, capped = total, None, -1
    share = None
    while True:
        over = F.lit(False) if share is None else share > cap
        got = sources.agg(
            F.count(F.when(over, 1)).alias("capped"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if got.capped == capped:
            break
        capped, rest, weight = got.capped, total - got.words, got.weight
        share = F.col("weight").cast("double") * float(rest) / float(max(weight, 1))
    return sources.withColumn("target", F.least(share, cap.cast("double")) if weight else F.coalesce(whole, cap.cast("double")))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(rows: DataFrame) -> DataFrame:
    """Per source: source_size, target, ``copies`` of every document, and the ``threshold`` below which one more.

    ``rows``: source, size, place; read once per level.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = with_targets(stored(weighted(sources)))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    own = own.withColumn("copies", copies.cast("long"))
    own = own.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    # bucket: the boundary bucket so far, by its leading bits; below: words of the source before it.
    own = stored(own.withColumn("bucket", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.lit(None).cast("long")))
    for level in range(1, LEVELS + 1):
        left = BITS * (LEVELS - level)
        bounds = own.select(F.col("source").alias("of"), F.col("bucket").alias("parent"), "rest", "below")
        near = rows.join(bounds, same(F.col("source"), F.col("of"))).where(
            F.shiftright("place", left + BITS) == F.col("parent")
        )
        histogram = near.groupBy("of", F.shiftright("place", left).alias("cut"), "rest", "below").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("of").orderBy("cut")  # at most 2**BITS buckets of a source
        cumulated = histogram.withColumn("end", F.col("below") + F.sum("words").over(upto))
        boundary = cumulated.where(F.col("end") > F.col("rest")).groupBy("of").agg(
            F.min_by(F.struct("cut", (F.col("end") - F.col("words")).alias("before"), "words"), "cut").alias("b")
        )
        # A source without a boundary takes all of its parent bucket: the next bucket holds none of it.
        past = F.shiftleft(F.col("bucket") + 1, BITS)
        own = stored(
            own.join(boundary, same(F.col("source"), F.col("of")), "left").select(
                "source", "source_size", "weight", "target", "copies", "rest",
                F.coalesce(F.col("b.cut"), past).alias("bucket"),
                F.coalesce(F.col("b.before"), F.col("below")).alias("below"),
                F.col("b.words").alias("inside"),
            )
        )
    nearer = F.coalesce(2 * (F.col("rest") - F.col("below")) >= F.col("inside"), F.lit(False))
    return own.select(
        F.col("source").alias("of"), "source_size", "target", "copies",
        (F.col("bucket") + nearer.cast("long")).alias("threshold"),
    )


def times() -> Column:
    return F.col("copies") + (F.col("place") < F.col("threshold")).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken, source."""
    rows = stored(sized(docs))
    bounds = thresholds(rows)
    return rows.join(bounds, same(F.col("source"), F.col("of"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"), "source"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` the mix takes, as often as it takes them, with their own columns only."""
    bounds = thresholds(stored(sized(docs))).select("of", "copies", "threshold")
    rows = docs.select(F.struct("*").alias("row"), F.col("source"), place(F.col("doc_id")).alias("place"))
    taken = rows.join(bounds, same(F.col("source"), F.col("of"))).where(times() > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), times())).alias("copy")).select("row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS * LEVELS // 4}))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum({MOST} * source_size) OVER before, 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM s WINDOW before AS (
    ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT (total - capped)::DOUBLE AS rest, weights::DOUBLE AS weights FROM o
  WHERE weight::DOUBLE * (total - capped)::DOUBLE / weights::DOUBLE <= {MOST} * source_size
  ORDER BY capped, weights DESC LIMIT 1),
t AS (
  SELECT s.source, source_size,
    coalesce(least(weight::DOUBLE * l.rest / l.weights, ({MOST} * source_size)::DOUBLE), ({MOST} * source_size)::DOUBLE) AS target
  FROM s LEFT JOIN l ON true),
c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies,
    target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size AS rest
  FROM t),
h AS (SELECT source, place, sum(size)::BIGINT AS words FROM d GROUP BY source, place),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM h),
b AS (
  SELECT c.source, min(CASE WHEN upto > rest THEN place END) AS edge
  FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source GROUP BY c.source),
e AS (
  SELECT b.source, CASE WHEN edge IS NULL THEN {2 ** (BITS * LEVELS)}
    WHEN 2 * (rest - (upto - words)) >= words THEN edge + 1 ELSE edge END AS threshold
  FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source
  LEFT JOIN u ON b.source IS NOT DISTINCT FROM u.source AND u.place = edge)
SELECT doc_id, size, source_size, target, (size * (copies + (place < threshold)::BIGINT))::BIGINT AS taken, d.source
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
