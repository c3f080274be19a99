"""Ordered computations that survive a hot key.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. Here each
key is cut into blocks of the ordering column (a time bucket), the window runs inside
a block, and what earlier blocks contribute comes from one aggregate row per block.
A key holding a third of the table is then spread over as many tasks as it has blocks,
and the result equals the plain window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def time_block(ts: Column, days: int = 30) -> Column:
    return F.floor(F.unix_seconds(ts) / (86_400 * days))


def matched(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where NULL equals NULL, as in a window's partitions."""
    rest = [c for c in other.columns if c not in on]
    renamed = other.select(*[F.col(c).alias(f"_of_{c}") for c in on], *rest)
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(renamed, match, how).select(*rows.columns, *([] if how in ("left_semi", "left_anti") else rest))


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(op: str, local: Column, carry: Column) -> Column:
    if op == "sum":
        return F.coalesce(local, carry * 0) + F.coalesce(carry, local * 0)
    return F.greatest(local, carry) if op == "max" else F.least(local, carry)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    metrics: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum``/``max``/``min`` columns over ``order`` within ``keys``."""
    tagged = df.withColumn(BLOCK, block)
    inside = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select(
        "*", *[_AGG[op](col).over(inside).alias(f"_local_{name}") for name, (op, col) in metrics.items()]
    )
    totals = tagged.groupBy(*keys, BLOCK).agg(
        *[_AGG[op](col).alias(f"_total_{name}") for name, (op, col) in metrics.items()]
    )
    carry = totals.select(
        *keys,
        BLOCK,
        *[
            _AGG[op](f"_total_{name}").over(before).alias(f"_carry_{name}")
            for name, (op, _) in metrics.items()
        ],
    )
    joined = matched(local, carry, [*keys, BLOCK])
    return joined.select(
        *df.columns,
        *[
            _merge(op, F.col(f"_local_{name}"), F.col(f"_carry_{name}")).alias(name)
            for name, (op, _) in metrics.items()
        ],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """``row_number()`` within ``keys``."""
    out = running(df, keys, order, block, {name: ("sum", F.lit(1))})
    return out.withColumn(name, F.col(name).cast("int"))


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], block: Column, values: list[str]
) -> DataFrame:
    """Add ``prev_<value>`` columns holding the preceding row's values (``lag``)."""
    tagged = df.withColumn(BLOCK, block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    packed = F.struct(*values)
    local = tagged.withColumn("_local", F.lag(packed).over(inside))
    tails = tagged.groupBy(*keys, BLOCK).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carry = tails.select(*keys, BLOCK, F.lag("_tail").over(blocks).alias("_carry"))
    joined = matched(local, carry, [*keys, BLOCK])
    previous = F.coalesce("_local", "_carry")
    return joined.select(
        *df.columns, *[previous[v].alias(f"prev_{v}") for v in values]
    )


def trailing(
    df: DataFrame,
    keys: list[str],
    seconds: str,
    before: int,
    after: int,
    sums: dict[str, Column],
) -> DataFrame:
    """Sums over the RANGE ``[t - before, t + after]`` of an epoch-second column.

    Rows are first summed per distinct instant, then copied to the neighbouring time
    buckets they can reach, so no pairs are formed and no key lands in one task.
    """
    width = max(before, after, 1)
    per_instant = df.groupBy(*keys, seconds).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    home = F.floor(F.col(seconds) / width)
    reach = [0] + ([1] if before else []) + ([-1] if after else [])
    spread = per_instant.withColumn("_shift", F.explode(F.array(*[F.lit(r) for r in reach]))).withColumn(
        BLOCK, home + F.col("_shift")
    )
    frame = Window.partitionBy(*keys, BLOCK).orderBy(seconds).rangeBetween(-before, after)
    return spread.select(
        *keys, seconds, "_shift", *[F.sum(n).over(frame).alias(n) for n in sums]
    ).where("_shift = 0").drop("_shift")
