"""Exact percentiles over strictly earlier rows, also for a key of any size.

For ordinary keys a window does it. A running percentile has no mergeable state, so for a
key with very many rows the window would be one endless task. There the wanted rank is
followed down the digits of the value instead: at each level, rows that share the digits
found so far form a node, running counts per next digit say which digit the ranked value
has, and the rank is reduced by the smaller digits. Each level is a blocked running sum, so
a hot key is spread over its time blocks and digit nodes. The result is the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redebit.operators import ordered
from redebit.session import checkpointed

HOT_ROWS = 2_000
DIGIT_BITS = 4
RADIX = 1 << DIGIT_BITS


def running_percentiles(df: DataFrame, keys: list[str], order: list[str], block: Column,
                        wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """Add one linear-interpolated percentile per entry; values are whole numbers of any sign.

    ``order`` must identify a row within its key. One small job finds out whether any key is
    hot; without hot keys the plan holds a plain window only.
    """
    values = {name: f"_v_{name}" for name in wanted}
    tagged = df.select("*", *[value.cast("bigint").alias(values[n]) for n, (value, _) in wanted.items()])
    sizes = tagged.groupBy(*keys).agg(
        F.count("*").alias("_rows"), *[f(c).alias(f"{p}{c}") for c in values.values() for p, f in (("_hi", F.max), ("_lo", F.min))]
    ).where(F.col("_rows") > HOT_ROWS)
    tops = sizes.agg(
        F.count("*").alias("_keys"),
        *[f(f"{p}{c}").alias(f"{p}{c}") for c in values.values() for p, f in (("_hi", F.max), ("_lo", F.min))],
    ).first()
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def windowed(rows: DataFrame) -> DataFrame:
        return rows.select(
            *df.columns,
            *[F.percentile(values[n], F.lit(p)).over(earlier).alias(n) for n, (_, p) in wanted.items()],
        )

    if tops["_keys"] == 0:
        return windowed(tagged)
    hot = sizes.select(*keys)
    usual = windowed(ordered.matched(tagged, hot, keys, "left_anti"))
    busy = checkpointed(ordered.matched(tagged, hot, keys, "left_semi").withColumn(ordered.BLOCK + "_t", block))
    out = busy.select(*df.columns)
    for name, (_, p) in wanted.items():
        v = values[name]
        # Digits need values from 0 on: the descent runs on the distance from the least value.
        low = tops[f"_lo{v}"] or 0
        found = _descend(busy.withColumn(v, F.col(v) - low), keys, order, v, p, (tops[f"_hi{v}"] or 0) - low, name)
        found = found.select(*keys, *order, (F.col(name) + low).alias(name))
        out = ordered.matched(out, found, [*keys, *order], "left")
    return usual.unionByName(out)


def _descend(rows: DataFrame, keys: list[str], order: list[str], value: str, p: float, top: int, name: str) -> DataFrame:
    time = ordered.BLOCK + "_t"
    place = [*keys, *order, time]
    counted = ordered.running(
        rows.select(*place, value), keys, order, F.col(time), {"_n": ("sum", F.col(value).isNotNull().cast("bigint"))}, inclusive=False
    ).where("_n > 0")
    position = (F.col("_n") - 1) * p
    ranks = F.array(
        F.struct(F.lit(0).alias("_side"), F.floor(position).alias("_k")),
        F.struct(F.lit(1).alias("_side"), F.least(F.floor(position) + 1, F.col("_n") - 1).alias("_k")),
    )
    asked = checkpointed(counted.select(*place, "_n", F.inline(ranks), F.lit(0).cast("bigint").alias("_prefix")))
    levels = max(1, -(-max(int(top), 1).bit_length() // DIGIT_BITS))
    for level in range(levels - 1, -1, -1):
        shift = level * DIGIT_BITS
        facts = rows.where(F.col(value).isNotNull()).select(
            *place, F.lit(None).cast("bigint").alias("_n"), F.lit(2).alias("_side"), F.lit(None).cast("bigint").alias("_k"),
            F.shiftright(value, shift + DIGIT_BITS).alias("_prefix"), F.shiftright(value, shift).bitwiseAND(RADIX - 1).alias("_digit"),
        )
        both = facts.unionByName(asked.withColumn("_digit", F.lit(None).cast("bigint")))
        # A question sorts before the fact of its own row, so a row never counts itself.
        below = {f"_c{d}": ("sum", F.when(F.col("_digit") <= d, 1).otherwise(0)) for d in range(RADIX)}
        seen = ordered.running(both, [*keys, "_prefix"], [*order, "_side"], F.col(time), below, inclusive=False).where("_side < 2")
        digit, passed = F.lit(RADIX - 1), F.col(f"_c{RADIX - 2}")
        for d in range(RADIX - 2, -1, -1):
            hit = F.col(f"_c{d}") > F.col("_k")
            digit = F.when(hit, d).otherwise(digit)
            passed = F.when(hit, F.col(f"_c{d - 1}") if d else F.lit(0)).otherwise(passed)
        asked = checkpointed(seen.select(
            *place, "_n", "_side", (F.col("_k") - F.coalesce(passed, F.lit(0))).cast("bigint").alias("_k"),
            (F.col("_prefix") * RADIX + digit).alias("_prefix"),
        ))
    low, high = (F.max(F.when(F.col("_side") == s, F.col("_prefix"))) for s in (0, 1))
    pairs = asked.groupBy(*keys, *order, "_n").agg(low.alias("_lo"), high.alias("_hi"))
    fraction = (F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)
    return pairs.select(*keys, *order, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * fraction).alias(name))
