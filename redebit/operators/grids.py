"""Hourly slots as grids: one row per cycle, its slots along the second axis, solved in NumPy.

The functions here are those of ``functions.calendar``, ``legality`` and ``priors`` of the same names, over all slots
of many cycles at once. A cycle crosses to Python once, with its curve, in place of a row per slot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from redebit.functions import calendar as cal
from redebit.operators import priors

CELLS = priors.DAYS * priors.BANDS  # and one more, for slots without a day

_MINUTE = np.arange(cal.DAY // 60)
_BAND = np.searchsorted(cal.HOUR_BAND_EDGES, _MINUTE, "right").astype(np.int32)
_UPI = (_MINUTE < 600) | ((_MINUTE >= 780) & (_MINUTE < 1020)) | (_MINUTE >= 1290)
_CLEARING = _MINUTE < 780


@dataclass(frozen=True)
class SlotGrid:
    """Cycles of which each has the slots 0..horizon-1; ``fill`` gives columns of those from a table of cycles."""

    cycles: DataFrame
    horizon: int
    fill: Callable[[pa.Table, int], dict[str, np.ndarray]]

    @property
    def schema(self) -> StructType:
        return StructType([*self.cycles.schema.fields, StructField("slot", IntegerType())])

    def of(self, cycles: DataFrame) -> SlotGrid:
        """The same slots of other cycles, or of these with more facts."""
        return replace(self, cycles=cycles)

    def with_fact(self, name: str, value: Column) -> SlotGrid:
        return self.of(self.cycles.withColumn(name, value))


def slot_grid(cycles: DataFrame, keys: list[str], horizon: int, fill: Callable[[pa.Table, int], dict[str, np.ndarray]],
              together: bool = False) -> SlotGrid:
    """``legality.explode_slots`` without the rows: cycles are distributed by ``keys``; those of one key follow each other if ``together``."""
    partitions = int(cycles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cycles.withColumn("_due", F.unix_seconds("due_at")).drop("due_at").repartition(partitions, *keys)
    return SlotGrid(dealt.sortWithinPartitions(*keys) if together else dealt, horizon, fill)


def with_cells(cycles: DataFrame, learned: DataFrame, of: Callable[[Column, Column], Column]) -> DataFrame:
    """``priors.with_curve`` with ``of(hazard, band)`` of every cell as ``cells``, and that of a slot without a day as the last."""
    overall, no_band = priors.global_prior(learned).scalar(), F.lit(None).cast("int")
    cells = F.transform("curve", lambda h, k: of(h, k % priors.BANDS))
    by_segment = priors.segment_curves(learned).select("mcc", "ticket_band", "rail", cells.alias("cells"))
    banded = cycles.withColumn("ticket_band", cal.ticket_band(F.col("amount_paise")))
    joined = banded.join(by_segment, ["mcc", "ticket_band", "rail"], "left").withColumn("global_hazard", overall)
    unseen = F.flatten(F.array_repeat(F.array(*[of(F.col("global_hazard"), F.lit(b)) for b in range(priors.BANDS)]), priors.DAYS))
    return joined.withColumn("cells", F.concat(F.coalesce("cells", unseen), F.array(of(F.col("global_hazard"), no_band))))


def floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64(), safe=False).to_numpy()


def clock(table: pa.Table, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per slot the minute and the number of days since the first, IST; per cycle the first day's number; which cycles have no due date."""
    due = table.column("_due")
    gone = due.is_null().to_numpy()
    local = due.fill_null(0).to_numpy().astype(np.int64) + cal.IST_OFFSET_SECONDS
    first = local // cal.DAY
    seconds = (local - first * cal.DAY).astype(np.int32)[:, None] + np.arange(horizon, dtype=np.int32) * np.int32(3600)
    day = seconds // np.int32(cal.DAY)
    return (seconds - day * np.int32(cal.DAY)) // np.int32(60), day, first, gone


def slot_cells(minute: np.ndarray, day: np.ndarray, first: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The cell of a curve that a slot reads."""
    days = (first[:, None] + np.arange(int(day.max(initial=0)) + 1)).astype("M8[D]")
    start = ((days - days.astype("M8[M]")).astype(np.int32)) * np.int32(priors.BANDS)
    cell = start.ravel()[day + (np.arange(len(first), dtype=np.int32) * np.int32(start.shape[1]))[:, None]] + _BAND[minute]
    cell[gone] = CELLS
    return cell


def read_cells(table: pa.Table, cell: np.ndarray) -> np.ndarray:
    held = table.column("cells").combine_chunks()
    values = (held if isinstance(held, pa.Array) else held.chunk(0)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values[cell + (np.arange(len(table), dtype=np.int64) * (CELLS + 1))[:, None]]


def harness_legal(table: pa.Table, minute: np.ndarray, day: np.ndarray, first: np.ndarray, gone: np.ndarray, days: int, lead: int = 25) -> np.ndarray:
    """``legality.harness_legal`` per slot, false where it is null."""
    rail = table.column("rail").to_numpy()
    legal = np.zeros(minute.shape, bool)
    legal[rail == cal.CARD] = True
    upi, clearing = (rail == cal.UPI) & ~gone, (rail == cal.ENACH) & ~gone
    legal[upi] = _UPI[minute[upi]]
    legal[clearing] = _CLEARING[minute[clearing]] & ((first[clearing, None] + day[clearing] + 3) % 7 < 5)
    slot = np.arange(minute.shape[1])
    return legal & (slot >= lead) & (slot < days * 24)


# Java's StrictMath.exp, so that a survival has the bits that Spark's exp gives it and ties stay ties.
_LN2_HIGH, _LN2_LOW, _INV_LN2 = 6.93147180369123816490e-01, 1.90821492927058770002e-10, 1.44269504088896338700e00
_P = (1.66666666666666019037e-01, -2.77777777770155933842e-03, 6.61375632143793436117e-05, -1.65339022054652515390e-06, 4.13813679705723846039e-08)
_REDUCED = float(np.array(0x3FD62E43 << 32, np.int64).view(np.float64))
_TINY, _LEAST = 2.0**-28, -7.45133219101941108420e02


def strict_exp(x: np.ndarray) -> np.ndarray:
    """exp of numbers up to 0 as the JDK computes it."""
    x = np.asarray(x, np.float64)
    safe = np.maximum(x, _LEAST)
    k = np.where(safe > -_REDUCED, 0.0, np.trunc(_INV_LN2 * safe - 0.5))
    high, low = safe - k * _LN2_HIGH, k * _LN2_LOW
    r = high - low
    t = r * r
    c = r - t * (_P[0] + t * (_P[1] + t * (_P[2] + t * (_P[3] + t * _P[4]))))
    y = 1.0 - ((low - (r * c) / (2.0 - c)) - high)
    whole = k.astype(np.int64)
    out = y * ((np.maximum(whole, -1021) + 1023) << 52).view(np.float64)
    deep = whole < -1021
    if deep.any():
        out[deep] = np.ldexp(y[deep], whole[deep].astype(np.int32))
    out = np.where(safe > -_TINY, 1.0 + safe, out)
    return np.where(x < _LEAST, 0.0, out)


def survival_curve(steps: np.ndarray) -> np.ndarray:
    """The running product of 1 - h from logarithms of its factors."""
    return strict_exp(np.cumsum(steps, axis=1))
